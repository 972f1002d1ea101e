"""The training-data operators against brute force, round trips and their SQL, with awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, chat, decontaminate, langid, licenses, packing, secrets, simhash, toxicity, urlfilter
from factloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, "x") for r in rows]
    return spark.createDataFrame(full, DOC)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 60_000), (6, "two words"), (6, "two words"), (None, "no id here at all"), (7, "ümläut 你好 😀 x" * 3)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = db.sql(ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    a, b = (sorted(x.astype(object).where(x.notna(), None).values.tolist(), key=repr) for x in (got[key], want[key]))
    assert a == b


# SimHash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks_miss_no_pair():
    keep, rng = simhash.masks(), random.Random(1)
    assert len(keep) == 15
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not flips & m for m in keep)


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_against_brute_force(spark, block):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(40)) for _ in range(6)]
    rows = [(i, base[i % 6] if i % 3 else base[i % 6] + " " + rng.choice("xyz")) for i in range(10, 60)] + [r for r in AWKWARD if r[0]]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = {}
    left = list(range(len(prints)))
    while left:
        stack, seen = [left[0]], {left[0]}
        while stack:
            a = stack.pop()
            for b in left:
                if b not in seen and (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                    seen.add(b)
                    stack.append(b)
        least = min(prints[k][0] for k in seen)
        group |= {k: least for k in seen}
        left = [k for k in left if k not in seen]
    want = sorted((i, f"{p:016x}", group[k]) for k, (i, p) in enumerate(prints))
    assert sorted(map(tuple, simhash.near_duplicates(docs(spark, rows), block=block).collect())) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# Language


def test_language_profiles(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(d).where("held_out").select("lang", "lang_pred").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_of_awkward_rows(spark):
    names, prototypes = langid.fit(spark.createDataFrame([("der die das und", "de"), ("the of and to", "en"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert names == ["de", "en"]
    rows = langid.predict(docs(spark, AWKWARD), names, prototypes).collect()
    und = sorted(r.doc_id for r in rows if r.lang_pred == "und")
    assert len(rows) == len(AWKWARD) and und == [1, 2, 3] and all(0 <= r.score <= 1 for r in rows)
    copies = spark.createDataFrame([("mille fois", "fr")] * 300 + [(f"text {i}", "en") for i in range(300)], "text string, lang string")
    assert langid.fit(copies, per_language=50)[0] == ["en", "fr"]
    none = langid.predict(docs(spark, [(1, "abc")]), [], np.zeros((0, langid.DIMENSIONS), np.float32)).collect()
    assert none[0].lang_pred == "und"


def test_language_against_brute_force(spark):
    """Prototypes and cosines by loops over the trigrams."""
    first, second, third = langid._letter_vectors(langid.DIMENSIONS)
    number = lambda c: int(langid._letter_ids()[ord(c)])

    def bundle(text):
        letters = [0] + [number(c) for c in re.sub(r"[^a-z]+", "\n", text.lower())] + [0]
        letters = [x for k, x in enumerate(letters) if x or not k or letters[k - 1]]
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            out += first[a].astype(float) * second[b] * third[c]
        return out / (np.linalg.norm(out) or 1)

    rng = random.Random(6)
    make = lambda bits: " ".join("".join(rng.choice(bits) for _ in range(3)) for _ in range(30))
    train = [(make(["ka", "to", "mi"]), "x") for _ in range(20)] + [(make(["sch", "ung", "ei"]), "y") for _ in range(20)]
    asked = [(i, make(["ka", "to", "mi"] if i % 2 else ["sch", "ung", "ei"])) for i in range(10)]
    names, prototypes = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    want = {k: sum(bundle(t) for t, lang in train if lang == k) for k in "xy"}
    for r in langid.predict(docs(spark, asked), names, prototypes).collect():
        cosine = {k: bundle(r.text) @ v / np.linalg.norm(v) for k, v in want.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) == ("x" if r.doc_id % 2 else "y") and abs(r.score - cosine[r.lang_pred]) < 1e-4


# Secrets


def plain_base(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), len(out) and 0, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return sorted((s, order.index(k), e, k) for s, _, k, e in out)


def test_secrets(spark):
    key, live = "AKIA" + "Q" * 3 + "1234567890ABC", "ghp_" + "a1B2c3D4e5F6g7H8i9J0"
    rows = [(1, f"😀 password = hunter22 and {key}", "a"), (2, "token: abc token: abcdef secret: token: abcdefgh", "a"), (3, f"{live} {'0f' * 15}", "b"), (4, f"Api_Key='{'9' * 8}'", "c"), *[(10 + i, f"{i}: token=changemechangeme", f"o{i}") for i in range(4)], *[(20 + i, f"{i}, token=s3cR3t-K3y-0f-4ll", f"o{i}") for i in range(4)], *[(30 + i, "passwd: copiedcopied", f"o{i}") for i in range(4)], *[(100 + k, r[1]) for k, r in enumerate(AWKWARD)]]
    found = {}
    for r in secrets.scan(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r.secrets)
    for i, text, *_ in rows:
        got = [(s.start, s.ord, s.stop, s.kind) for s in found[i][0] if s.ord < 3]
        assert got == plain_base(text), text
    assert [s["class"] for s in found[11][0]] == ["example"] and found[11][0][0].n_owners == found[11][0][0].n_repositories == 4
    assert [(s["class"], s.n_owners, s.n_repositories) for s in found[31][0]] == [("shared", 1, 4)]  # copies of one text
    assert any(s.kind == "prefixed" and s["class"] == "live" for s in found[3][0])
    clean = {r.doc_id: r for r in secrets.redact(docs(spark, rows)).collect()}
    assert "hunter22" not in clean[1].text and clean[1].n_chars == len(clean[1].text) and clean[1].kind == "x"
    assert clean[11].text == "1: token=changemechangeme" and clean[21].text == "1, token=[SECRET]" and clean[31].text == "passwd: [SECRET]" and clean[4].text.startswith("Api_Key='[SECRET]")
    assert len(secrets.redact(docs(spark, rows)).collect()) == len(rows)
    assert secrets.scan(docs(spark, [])).count() == 0
    names = spark.createDataFrame([(1, "token=abcdefgh", 2, 3, 4, 5)], "doc_id long, text string, _id int, _digest int, _new int, _blocks int")
    assert tuple(secrets.redact(names).first()) == (1, "token=[SECRET]", 2, 3, 4, 5)


def test_secrets_in_overlapping_places(spark):
    hexa = "0123456789abcdef" * 2
    text = f"é token='{hexa}' and {hexa}, secret=AKIA{'Z' * 16}{'9' * 8}; " + "x" * 1020 + f" passwd:{'w' * 3000} end"
    clean = secrets.redact(docs(spark, [(1, text)])).first()
    assert clean.text == f"é token='[SECRET]' and [SECRET], secret=[SECRET]; " + "x" * 1020 + " passwd:[SECRET] end" and clean.n_chars == len(clean.text)


def test_secrets_take_time_in_proportion_to_length(spark):
    import time

    def seconds(text):
        began = time.perf_counter()
        out = secrets.redact(docs(spark, [(1, text)])).first().text
        return time.perf_counter() - began, out

    many = "".join(f"token=a{i:07d} " for i in range(60_000))  # 0.9 MB of secrets
    runs = "eyJ" * 330_000
    seconds(many[:1500])
    took, out = seconds(many)
    assert out == "token=[SECRET] " * 60_000 and took < 60
    took, out = seconds(runs)
    assert took < 30


# Decontamination


def test_decontamination(spark):
    item = "In the race Anna ran 12 km in the rain while Bert and Anna drank 3 liters of cold tea together"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item)], "item_id long, text string")
    rows = [
        (100, f"Before it. {item}. And after it."), (101, f"before, {item.upper()} after"), (102, item.replace("Anna", "Carla").replace("Bert", "Dora").replace("12 km", "90 miles").replace("3 liters", "7 pounds")),
        (103, item.replace("Anna", "Carla", 1)), (104, "In the race someone ran in the sun while others slept and drank nothing of cold tea"), *AWKWARD,
    ]
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert {100, 102} <= set(got) and not {104, 1, 2, 5, 6, None} & set(got)
    assert got[100].verbatim and not got[102].verbatim and got[102].item_id == 1
    kept = decontaminate.clean(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r[0] for r in rows} - set(got)
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def plain_template(text):
    """Words with what stands for them: (word, typed, folded)."""
    import regex

    text = regex.sub(r"([\p{L}\p{M}\p{N},;)])\x20(?=\p{Lu}[\p{Ll}\p{M}]+(?!\p{L}))", "\\1 \x01", text)
    text = regex.sub(rf"([0-9])\x20?(?=(?i:{'|'.join(decontaminate.UNITS)})(?![\p{{L}}\p{{M}}]))", "\\1 \x02", text)
    out = []
    for raw in regex.findall(r"[\x01\x02]?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*", text.lower()):
        word = raw.strip("\x01\x02")
        typed = {"\x01": "NAME", "\x02": "UNIT"}.get(raw[0], "NUM" if raw[0].isdigit() else word)
        unit = typed == "NAME" and out and out[-1][1] == "NUM" and word in decontaminate.UNITS
        out.append((word, typed, "UNIT" if unit else word if typed == "NAME" else typed))
    return out


def plain_found(text, item):
    """Whether consistent occurrences hold 0.8 of the item's windows, by comparing each window with each."""
    doc = plain_template(text)
    for form in (1, 2):
        mine, inside = plain_template(item), plain_template(", " + item)
        at = {}
        for words in [mine] + ([inside] if form == 1 else []):
            for k in range(len(words) - 4) if words is mine else range(min(1, len(words) - 4)):
                window = [w[form] for w in words[k : k + 5]]
                slots = [w in ("NAME", "UNIT", "NUM") for w in window]
                if slots.count(False) >= 3:
                    at.setdefault(k, []).append((window, slots, [w[0] for w in words[k : k + 5]]))
        shifts = {}
        for k, forms in at.items():
            for window, slots, own in forms:
                for p in range(len(doc) - 4):
                    if [w[form] for w in doc[p : p + 5]] == window:
                        s = shifts.setdefault(p - k, (set(), set()))
                        s[0].add(k)
                        s[1].update((a, w[0]) for a, w, slot in zip(own, doc[p : p + 5], slots) if slot)
        held = {k for places, pairs in shifts.values() if len({a for a, _ in pairs}) == len(pairs) for k in places}
        if at and len(held) >= 0.8 * len(at):
            return True
    return False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    items = [
        "In the race Anna ran 12 km in the rain while Bert and Anna drank 3 liters of cold tea together",
        "Maria has 24 apples and gives 6 apples to Peter so how many apples does Maria have left after Peter eats 2 of them",
        "a train leaves the old station at 9.30 and drives 80 km until it stops for 15 minutes near the river",
    ]
    names, nouns = ["Carla", "Dora", "Emil", "Fritz"], ["12", "90", "7", "3.5", "1,200"]
    rows = []
    for i in range(240):
        words = rng.choice(items).split()
        people = {w: rng.choice(names) for w in ("Anna", "Bert", "Maria", "Peter")} if i % 3 else {}
        words = [people.get(w, w) for w in words]
        kind = i % 6
        if kind == 1:
            words = [rng.choice(nouns) if w[0].isdigit() and rng.random() < 0.5 else w for w in words]
        if kind == 2:
            words[rng.randrange(len(words))] = rng.choice(["tree", "Anna", "9"])
        if kind == 3:
            del words[rng.randrange(len(words))]
        if kind == 4:
            words = words[: rng.randint(3, len(words))]
        text = " ".join(words)
        rows.append((1000 + i, "so it was said, " + (text.upper() if kind == 5 else text) + " and that was all. " + rng.choice(items)[: rng.randint(0, 40)]))
    rows.append((103, items[0].replace("Anna", "Carla", 1)))  # Anna is Carla in one place and Anna in another
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), bench).select("doc_id", "item_id").collect()}
    want = {(i, k) for i, text in rows for k, item in enumerate(items) if plain_found(text, item)}
    assert got == want and 60 < len(want) < 240 and not any(i == 103 for i, _ in got)


def test_decontamination_judges_each_text(spark):
    item = "In the race Anna ran 12 km in the rain while Bert and Anna drank 3 liters of cold tea together"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = item.split(" while ")
    rows = [(None, f"so {item} it is"), (None, "a clean text without id"), (None, half[0]), (None, f"while {half[1]}"), (7, item), (7, "another clean text"), (8, half[0]), (8, f"while {half[1]}"), (9, None), (None, None)]
    kept = [(r.doc_id, r.text) for r in decontaminate.clean(docs(spark, rows), bench).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)
    folded = decontaminate.contaminated(docs(spark, rows), bench, by=("doc_id",)).collect()
    assert sorted((repr(r.doc_id), r.n_items) for r in folded) == [("7", 1), ("None", 1)]


def test_items_in_another_case_are_found(spark):
    item = "In the race Anna ran 12 km in the rain while Bert and Anna drank 3 liters of cold tea together"
    german = "Am Morgen ging der Bäcker mit dem Hund über die Straße zum Markt und kaufte dort zwölf Eier"
    bench = spark.createDataFrame([(1, item), (2, german)], "item_id long, text string")
    rows = [(100 * i + k, f"before, {t} after") for i, text in ((1, item), (2, german)) for k, t in enumerate((text, text.upper(), text.lower(), text.title()))]
    rows += [(300, item.replace("Anna", "Carla").replace("Bert", "Dora")), (301, item.lower().replace("12 km", "90 miles")), (400, "in the race someone ran in the sun while others slept and drank nothing of cold tea")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(i, 2 if 200 <= i < 300 else 1) for i, _ in rows if i != 400}


def test_items_without_countable_windows(spark):
    items = ["too short", "What is 12 + 7 - 3 + 88?", "猫が好きです。犬も好きですか", "1 2 3 4 5 6 7", "?!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(10, "it was Too  short, they said"), (11, f"Asked: {items[1]} No idea."), (12, f"昨日、{items[2]}と聞いた"), (13, "so 1 2 3 4 5 6 7"), (20, "too very short"), (21, "What is 12 + 7 - 3 + 89?"), (22, "猫が嫌いです。犬も苦手でしたか"), (23, "1 2 3 4 5 6 8"), (24, "too"), *AWKWARD]
    got = {(r.doc_id, r.item_id, r.coverage, r.verbatim) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(10 + i, i, 1.0, True) for i in range(4)}


def test_benchmark_passages_are_found(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in b.collect()]
    want = {r.doc_id for r in d.collect() if any(t in r.text for t in items)}
    got = {r.doc_id for r in decontaminate.contaminated(d, b).collect()}
    assert want and want == got


# Packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = [*AWKWARD, *[(20 + i, "the cat's sat, on É mats! " * i) for i in range(30)], *[(60, "same text")] * 7]
    got = packing.pack(docs(spark, rows), capacity=64, ranked=3).collect()
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(w[3] for w in want) // 64) + 2
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_equals_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 200))]
        slots = packing.plan({n: lengths.count(n) for n in set(lengths)}, 50)
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(50 - n)
        used = {s[3] + k for s in slots for k in range(s[2] // s[5])}
        assert used == set(range(len(rooms)))


# Url filter


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = urlfilter.build(keys, rate=0.5)
    assert len(levels) > 2
    assert keys.where(urlfilter.listed(F.col("key"), levels) != F.col("listed")).count() == 0


def test_urls(spark):
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://Blog.EXAMPLE.com/en/7x?a#b"), (4, "x://a.net/de/"), (5, "x://example.net/de/8"), (6, "x://evil.test"), (6, "x://evil.test"), (7, "x://evil.test?q=/en/"), (8, "://org/es/1"), (9, "x://notcom/en/"), (10, "x://É.com/en/")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    listed = spark.createDataFrame([("evil.test",), (None,), ("absent",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("blog.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == (None, "block")
    assert got[7][:2] == ("evil.test", "") and got[8][2:] == ("org/es/", "block") and got[9][2] is None and got[10][0] == "É.com"
    assert urlfilter.judge(pages, listed).count() == len(urls) and urlfilter.judge(pages.limit(0), listed).count() == 0


def test_a_long_list_is_exact_in_parts(spark):
    keys = spark.range(1_250_000).select(F.concat(F.lit("h"), "id", F.lit(".test")).alias("key"), (F.col("id") % 5 > 0).alias("listed"))
    pages = keys.select(F.xxhash64("key").alias("page_id"), F.concat(F.lit("x://"), "key", F.lit("/p")).alias("url"))
    for most in (urlfilter.MOST_BITS, 1 << 20):
        got = urlfilter.judge(pages, keys.where("listed").select("key"), most_bits=most)
        wrong = got.select(F.col("host").alias("key"), "verdict").join(keys, "key").where((F.col("verdict") == "block") != F.col("listed"))
        assert wrong.count() == 0


# Chat


def test_chat_round_trip():
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/s>", "x", " ", "\n", "😀"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, None), (1, 5, 4, None, "end", 0.5), (2, 1, 99, "user", "orphan", 0.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    p = {}
    for r in chat.paths(m).collect():
        p.setdefault((r.tree, r.leaf), {})[r.up] = r.node
    assert {k: [v[i] for i in sorted(v)] for k, v in p.items()} == {(1, 2): [2, 1], (1, 5): [5, 4, 3, 1], (2, 1): [1]}
    best = {r.tree: r for r in chat.conversations(m).collect()}
    assert chat.parse(best[1].formatted) == [("user", "q"), ("assistant", "good"), ("user", ""), ("", "end")]
    assert chat.conversations(m, branches=None).count() == 3 and chat.conversations(m.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "tree long, node long, parent long"))


def test_repeated_and_unnumbered_messages(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.1), (1, 3, 2, "user", "b", 0.1)] * 2 + [(1, 2, 1, "assistant", "z", 9.0), (2, None, None, "user", "alone", 0.0), (2, None, None, "user", "alone", 0.0), (None, 1, None, "user", "x", None)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): chat.parse(r.formatted) for r in chat.conversations(m, branches=None).collect()}
    assert got == {(1, 3): [("user", "q"), ("assistant", "a"), ("user", "b")], (2, None): [("user", "alone")], (None, 1): [("user", "x")]}


def test_a_long_reply_tree(spark):
    n = 3000
    rows = [(7, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"{i} " + "y" * 200, 0.0) for i in range(n)] + [(7, n, 5, "assistant", "x" * 300_000, 5.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {r.leaf: chat.parse(r.formatted) for r in chat.conversations(m, branches=2).collect()}
    assert len(got[n - 1]) == n and len(got[n]) == 7 and got[n][-1] == ("assistant", "x" * 300_000)


def test_turns_without_a_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "who"), (None, 1, "assistant", "nobody"), (0, 0, "user", "zero"), (0, 1, "assistant", None), (None, 2, None, "end")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op10_chat(spark, f"file://{tmp_path}")
    want = db.sql(chat.OP10_SQL).fetchall()
    assert sorted(map(tuple, got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=repr) == sorted(want, key=repr)
    assert len(want) == 3 and chat.paths(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).where("tree is null").count() == 3


# Nearest neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[200:500] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 32, 0), (2040, [float("nan")] * 32, 0), (2060, [1.0], 0), (2080, [2.0], 0), (2081, [-3.0], 0), (None, x[1].tolist(), 0), (0, (2 * x[0]).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {*range(0, 1500, 20), 2060, 2080}
    assert got[2060] == [(2080, 2.0), (2081, -3.0)] and got[2080] == [(2060, 2.0), (2081, -6.0)]
    whole = np.concatenate((x, [x[1], 2 * x[0]]))
    ids = [*range(1500), None, 0]
    hit = 0
    for q in range(20, 1500, 20):
        s = whole @ x[q]
        s[q] = -np.inf
        best = np.sort(s)[::-1][:20]
        assert len(got[q]) == 20 and all(any(i == j and abs(v - t) < 1e-9 for j, t in zip(ids, s)) for i, v in got[q])
        hit += np.sum([v >= best[-1] - 1e-9 for _, v in got[q]])
    assert hit / (20 * len(range(20, 1500, 20))) >= 0.9
    # Two rows have the id 0 and both are asked; each finds the other, and then the copies by their ids.
    assert len(got[0]) == 40 and sorted(i for i, _ in got[0])[:2] == [0, 0] and {*range(200, 219)} <= {i for i, _ in got[0]}
    assert ann.neighbours(df.limit(0)).count() == 0


def test_lists_prune_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 32)) * 3
    x = centre[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32))
    rows = ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    index = ann.build(rows)
    assert len(index.coarse) == 78 and index.probes < len(index.coarse) / 4
    found = ann.search(index, index.rows.where("vec_id % 20 = 0").selectExpr("rid", "vec_id query_id", "vec")).collect()
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert sum(r.vec_id in best[r.query_id // 20] for r in found) / best.size >= 0.9


def test_queries_unlike_the_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 32)) * 3
    x = centre[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32))
    # The vectors lie in clusters and the queries between them, so a query's nearest vectors are in many lists.
    asked = np.arange(0, 6000, 20)
    x[asked] = rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    got = ann.neighbours(df).collect()
    assert len(got) == best.size and sum(r.vec_id in best[r.query_id // 20] for r in got) / best.size >= 0.95


# Toxicity


def plain_weights(train, corpus, relevance):
    """Weights of terms and unit vectors of the examples, by definition and with nothing but dicts."""

    def terms(text):
        out = {}
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            for t in (w, w[:6] + "*") if len(w) > 6 else (w,):
                out[t] = out.get(t, 0) + 1
        return out

    df = {}
    for text in corpus:
        for t in terms(text):
            df[t] = df.get(t, 0) + 1
    family = lambda text: toxicity._family(toxicity.words_of(text))
    bad, seen = {}, {}
    for text, y in train:
        bad[family(text)] = max(y, bad.get(family(text), 0))
        for t in terms(text):
            seen.setdefault(t, set()).add(family(text))
    f, f1 = len(bad), sum(bad.values())

    def weight(t):
        if t not in seen:
            return 0.0
        a, m = sum(bad[k] for k in seen[t]), len(seen[t])
        gap = max(abs(a * (f - f1) - (m - a) * f1) - f / 2, 0)
        x = f * gap * gap / (f1 * (f - f1) * m * max(f - m, 0.5)) + 0.25
        return np.log((1 + len(corpus)) / (1 + df[t])) * (x / (x + relevance) if relevance else 1)

    def vector(text):
        v = {t: (1 + np.log(n)) * weight(t) for t, n in terms(text).items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items() if x} if length else {}

    return vector


@pytest.mark.parametrize("relevance, long_lists", [(5.0, 1024), (0.0, 1024), (5.0, 3)])
def test_toxicity_against_brute_force(spark, monkeypatch, relevance, long_lists):
    monkeypatch.setattr(toxicity, "LONG_LISTS", long_lists)
    monkeypatch.setattr(toxicity, "FIRST", 1)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + [f"longword{i}" for i in range(30)]
    bad = ["vile", "nasty", "awful"]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            text[1:3] = rng.sample(bad, 2)
        rows.append((i, " ".join(text)))
    odd = [(1000 + k, r[1]) for k, r in enumerate(AWKWARD)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows + odd), labels, relevance=relevance)
    got = {r.doc_id: r for r in toxicity.score(docs(spark, rows + odd), model).collect()}
    assert len(got) == 409 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    train = [(t, int(i % 4 == 0), i) for i, t in rows if i < 300 and i != 5]
    vector = plain_weights([(t, y) for t, y, _ in train], [t for _, t in rows + odd], relevance)
    examples = [(vector(t), i) for t, _, i in train]
    for i, text in rows + odd:
        v = vector(text)
        cosine = sorted((sum(x * e.get(t, 0) for t, x in v.items()) for e, _ in examples), reverse=True)
        exact = {d: sum(x * e.get(t, 0) for t, x in v.items()) for e, d in examples}
        want = [c for c in cosine[: toxicity.NEIGHBOURS] if c > 1e-12]
        assert [e.cosine for e in got[i].evidence] == pytest.approx(want, abs=1e-6), i
        assert all(abs(exact[e.doc_id] - e.cosine) < 1e-6 and e.toxic == (e.doc_id % 4 == 0) for e in got[i].evidence)
    if relevance:
        assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(300, 400)]) > 0.97
        assert all(got[i].predicted == 0 for i, _ in odd)
    assert toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), labels.limit(0))).where("predicted = 1").count() == 0


def test_toxicity_keeps_all_telling_terms(spark):
    rng = random.Random(9)
    bad = [f"{chr(97 + i // 12)}{chr(97 + i % 12)}qxvzkjw" for i in range(120)]
    plain = lambda: [f"w{rng.randrange(3000)}" for _ in range(10)]
    rows = [(i, " ".join([*plain(), bad[i % 120]])) for i in range(600)] + [(i, " ".join([*plain(), *(["calm"] if i % 2 else [])])) for i in range(600, 4200)]
    asked = [(5000 + i, " ".join([*plain(), word])) for i, word in enumerate(bad)] + [(6000 + i, " ".join(plain())) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(4200)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows + asked), labels)
    assert len(model.terms) > 3000 and {"calm", *bad} <= set(model.terms)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, asked), model).collect()}
    assert np.mean([got[i] == (i < 6000) for i, _ in asked]) > 0.98


def test_toxicity_bounds_its_examples(spark):
    rows = [(i, f"text number {i} of some length") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs(spark, rows), labels, per_class=10).ids) == 20
    assert len(toxicity.fit(docs(spark, rows), labels, characters=100).ids) <= 8


# Licences


def test_telling_words_miss_no_unit():
    telling = licenses.telling_words()
    for _, text in licenses.TEMPLATES:
        words = licenses.template_words(text)
        pairs = list(zip(words, words[1:]))
        plain = [p for p in set(pairs) if not any(t in w for w in p for t in telling)]
        m = len(set(pairs))
        assert 2 * len(plain) / (len(plain) + m) < licenses.SIMILARITY


def test_licenses(spark):
    mit = licenses.TEMPLATES[16][1]
    rows = [(10, f"Copyright (c) 2020 Someone\n{mit}"), (11, "some words\nlicensed under the APACHE license version 2.0\nmore"), (12, "Licensed under nothing that anyone knows of"), (13, mit.replace("Software", "Program", 2)), *AWKWARD]
    got = {r.doc_id: r for r in licenses.licenses(docs(spark, rows)).collect()}
    assert set(got) == {10, 11, 13}
    assert got[10].best_license == "mit" and got[10].dice == 1.0 and got[11].licenses == "apache-2.0"
    assert licenses.licenses(docs(spark, [])).count() == 0


# Pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    bench = "the quick brown fox jumps over the lazy dog while nobody in the old town sleeps or eats"
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta " * 3), (2, "alpha beta gamma delta epsilon zeta eta theta " * 3), (3, f"so {bench} and so on"), (4, "my password = hunter22 is not safe to share with anyone at all"), (5, None), (6, "123 456"), (4, "my password = hunter22 is not safe to share with anyone at all")]
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminated", "without_secrets", "packed"]
    docs_in = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs_in = f(spark, docs_in, f"file://{tmp_path}")
        assert docs_in.columns == frame.columns
    assert "hunter22" not in " ".join(r.text for r in docs_in.collect())


def test_pipeline_keeps_different_texts_of_an_id(spark):
    import corpus_pipeline

    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (7, c), (7, e), (7, c), (None, a), (None, "f " * 9), (None, "f " * 9)]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (5, b), (7, c), (7, e), (None, "f " * 9)], key=repr)


def test_turn_hash_by_hand(spark):
    got = {r.conv_id: r for r in QUERIES["op10_chat"](spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and got[-7].loss_chars == len(text)
