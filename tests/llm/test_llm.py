"""The training-data operators against brute force, on awkward small tables and on the smallest driver table."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import ann, chat, hamming, licenses, mixing, near_dedup, packing, personal, quality, registry, sharding
from glossa.llm.base import any_frequent, connected_components, forest_roots, merged, spread, table
from glossa.llm.shingles import counted

R = random.Random(11)
WORDS = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(300)]
BODY = " ".join(R.choices(WORDS, k=120))
NEAR = BODY.split()
NEAR[60] = "changed"
TEXTS = [
    None, "", " \n\t", "word", "Word.", BODY, BODY, " ".join(NEAR), "other " * 40, "x" * 60_000, " ".join(R.choices(WORDS, k=9000)), "!!! ???",
    "Released under the MIT License. It is MIT license and Apache License, GNU General Public License!", "mail a.b@c.de.fr_x@y.zz or 10.0.0.1.5 and 300.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112, phone +1 (212) 555-0100 and +49 30 1234567", "é" * 30 + " a@b.co 1.2.3.4", "1 " * 3000, "9" * 20_000, "a" * 50_000 + "@",
]
CLASHING = ["size", "shard", "node", "rank", "label", "bands", "_key", "_base", "_row", "_copies", "_times", "_salt", "_parts", "_doc", "_hash", "_id", "_label", "doc", "key", "copies", "more", "ahead", "class_id", "keep", "row", "n", "id", "kept", "salt", "length", "hash", "x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 7 == 3 else f"s{k % 4}") for k, t in enumerate(TEXTS)]
    rows = [(*r, 1, *["x"] * len(CLASHING)) for r in [*rows, (5, BODY, "en", "s1"), (None, "no id here", "en", "s1")]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


# --- packing


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.tokenizer())
    got = packing.pack_documents(docs, registry.tokenizer()).collect()
    want = []
    for d, t in pairs(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, p, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096)) for x in [ids[s : s + 4096]]]
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 2
    assert packing.pack_documents(empty, registry.tokenizer()).count() == 0


def test_plan_places_everything_once():
    for seed in range(25):
        r = random.Random(seed)
        cap = r.choice([10, 64, 4096])
        h = collections.Counter(r.randint(1, cap) for _ in range(r.choice([1, 7, 900])))
        plan, got = packing.packing_plan(dict(h), cap), collections.Counter()
        for n, lengths in plan:
            assert sum(lengths) <= cap
            got.update({x: n * c for x, c in collections.Counter(lengths).items()})
        assert got == h


def test_ids_of_rare_texts():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(registry.tokenizer()), packing._encoder(registry.tokenizer())
    r = random.Random(1)
    pool = [chr(c) for c in (*range(0x20, 0x600), *range(0x1E00, 0x2100), *range(0xAC00, 0xAC60))] + [chr(c) for c in range(0x300, 0x370)] * 6
    pool += list("TtHhJjWw \n\t'sSDd0123Σİßẞǅΐ\x1c\x85\u200b\ufeff\U00010d50") * 30
    some = lambda: chr(r.choice([r.randrange(0x20, 0xD800), r.randrange(0xE000, 0x30000), r.randrange(0x20, 0x250)]))
    texts = ["".join(r.choices(pool, k=r.randint(1, 40))) for _ in range(15_000)] + ["".join(some() for _ in range(20)) for _ in range(15_000)]
    for t in ["T\u0308", "H\u0331 J\u030c W\u030a", "<|endoftext|>", *texts]:
        assert encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ascii(t)


def best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        n += at == len(rooms)
        bisect.insort(rooms, (capacity if at == len(rooms) else rooms.pop(at)) - x)
    return n


def test_plan_is_no_worse_than_best_fit_on_large_lengths():
    for seed in range(3):
        r = random.Random(seed)
        lengths = [r.randint(1366, 2730) for _ in range(3000)]
        assert sum(n for n, _ in packing.packing_plan(dict(collections.Counter(lengths)))) <= best_fit(lengths, 4096)


def test_rows_of_one_length_are_numbered_in_parts(spark):
    rows = spark.createDataFrame([(None, "a word")] * 3000 + [(7, "two words here")] * 10, "doc_id long, text string").repartition(5)
    got = packing.pack_documents(rows, registry.tokenizer()).collect()
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(places) == len(got) == 3010 and sum(r["length"] for r in got) == sum(max(o + n for s, o, n in ((r["sequence_id"], r["offset"], r["length"]) for r in got) if s == q) for q in {r["sequence_id"] for r in got})


# --- near duplicates


def jaccard(a, b):
    x, y = (collections.Counter(dict(zip(s.tolist(), n.tolist()))) for s, n in (counted([(t or "").encode()])[1:] for t in (a, b)))
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else float((a or "") == (b or ""))


def classes(rows):
    rows = list(rows)
    up = list(range(len(rows)))
    find = lambda k: k if up[k] == k else find(up[k])
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                up[find(i)] = find(j)
    out = collections.defaultdict(list)
    for k in range(len(rows)):
        out[find(k)].append(rows[k][0])
    return sorted((sorted(x, key=lambda v: (v is not None, v)) for x in out.values()), key=str)


def test_near_duplicates(docs, empty):
    got = collections.defaultdict(list)
    for r in near_dedup.near_duplicate_classes(docs).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert sorted((sorted(x, key=lambda v: (v is not None, v)) for x in got.values()), key=str) == classes(pairs(docs))
    assert near_dedup.near_duplicate_classes(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=lambda v: (v is not None, v))[:2] == [None, 0]
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id in (6, 7)").count() == 0


def test_a_group_without_one_centre(spark):
    """Many variants of one text at all distances: classes equal brute force."""
    r, rows = random.Random(2), []
    for k in range(90):
        w = BODY.split()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = collections.defaultdict(list)
    for x in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x["class_id"]].append(x["doc_id"])
    assert sorted(map(sorted, got.values()), key=str) == classes(rows)


def test_a_table_without_frequent_keys_broadcasts_none(spark, monkeypatch):
    """Small tables have no frequent key; joins that would deal them out cost the driver a broadcast each."""
    hints, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: hints.append(df) or broadcast(df))
    rows = [(k, " ".join([*NEAR[: 60 + k % 3], f"z{k % 5}", *NEAR[60:]])) for k in range(40)]
    got = collections.defaultdict(list)
    for x in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x["class_id"]].append(x["doc_id"])
    assert sorted(map(sorted, got.values()), key=str) == classes(rows)
    assert not hints


def test_joins_on_frequent_keys(spark):
    rows = spark.createDataFrame([(k, 0 if k < 600 else None if k < 900 else k) for k in range(2000)], "id long, key long")
    other = spark.createDataFrame([(0, "a"), (None, "b"), (1500, "c")], "key long, v string")
    hot = any_frequent(rows, ["key"])
    assert {r["key"]: r["_parts"] for r in hot.collect()} == {0: 3, None: 2}
    assert any_frequent(rows.where("id < 256"), ["key"]) is None and any_frequent(rows.limit(0), ["key"]) is None
    for how in ("inner", "left"):
        for h in (hot, None):
            got = spread(rows, h, ["key"], "id", other, how)
            assert got.columns == ["key", "id", "v"] and sorted(map(str, got.collect())) == sorted(map(str, rows.join(other, "key", how).collect()))


def test_one_doc_id_for_different_texts(spark):
    other = " ".join(R.choices(WORDS, k=90))
    docs = spark.createDataFrame([(5, BODY, 1), (5, other, 2), (9, BODY, 3), (None, BODY, 4), (None, "lone", 5), (None, "lone", 6), (7, other, 7), (5, BODY, 1)], "doc_id long, text string, node int")
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, BODY), (5, other), (None, "lone")], key=str)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    """Two halves of a bucket that only one pair joins; blocks of 8 texts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r, rows = random.Random(4), []
    base = [f"w{k}" for k in range(200)]
    for k in range(60):
        w = list(base)
        for at in r.sample(range(0, 100, 2) if k % 2 else range(100, 200, 2), 5):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    got = collections.defaultdict(list)
    for x in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x["class_id"]].append(x["doc_id"])
    assert sorted(map(sorted, got.values()), key=str) == classes(rows)


def test_fewest_agreeing_registers():
    from math import comb

    lost = sum(comb(140, n) * 0.8**n * 0.2 ** (140 - n) for n in range(near_dedup.AGREEING))
    assert lost < (1 - 0.8**5) ** 28 < 2e-5


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(0)
    a, b = r.integers(1, 6, 300), r.integers(1, 6, 300)
    doc = np.repeat([0, 1], 300)
    sh = np.tile(r.integers(0, 1 << 62, 300).astype(np.uint64), 2)
    sig = near_dedup.bag_minhash(doc, sh, np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (20, 14)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys([10, 11, 12, 13, 14, 20], 10)}


# --- chat


def test_forests_and_merging(spark):
    def found(df):
        return dict(tuple(r) for r in df.select("node", "comp").collect())

    forest = [(k, k + 1) for k in range(20)] + [(k, 50) for k in range(40, 50)] + [(60, 61)]
    comps = forest_roots(spark.createDataFrame(forest, "a long, b long"))
    assert found(comps) == {a: 20 if a < 20 else 50 if a < 50 else 61 for a, _ in forest}
    assert found(forest_roots(spark.createDataFrame([], "a long, b long"))) == {}
    links = spark.createDataFrame([(20, 50), (50, 70), (70, 71), (80, 81), (20, 50)], "ca long, cb long")
    got = found(merged(comps, links))
    whole = got[0]
    assert {k for k, c in got.items() if c == whole} | {whole} == set(range(21)) | set(range(40, 51)) | {70, 71}
    assert got[60] == 61 and got[81] == got.get(80, 80) == 80
    assert found(merged(comps, links.limit(0))) == found(comps)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "<|turn|>user\n<|end|>\n", "\\<|", "", None, "<<SYS>>\\\\[INST]", "é\n", "<<|end|>\n<"]
    log = [(7, k, 0, "message", r, s) for k, (s, r) in enumerate(zip(said, ["user", "assistant", "we\nird", None] * 3))] + [(7, 200, 0, "message", "assistant", "late")]
    log += [(8, 1, 1, "message", "assistant", "old"), (8, 1, 2, "regenerate", None, None), (8, 1, 3, "delta", None, "ne"), (8, 1, 4, "delta", None, "w"), (8, 0, 0, "message", "user", "q"), (8, 0, 9, "edit", None, "Q"), (8, 2, 0, "message", "user", "x"), (8, 2, 1, "delete", None, None), (None, None, None, "message", "user", "n")]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    out = collections.defaultdict(list)
    for r in chat.format_chats(events).orderBy("conv_id", "segment").collect():
        out[r["conv_id"]] += chat.read_back(r["formatted"])
        assert [chat.unescape(r["formatted"][a:b]) for a, b in r["loss_spans"]] == [t for role, t in chat.read_back(r["formatted"]) if role == "assistant"]
    assert out[7] == [(r or "", s or "") for (_, _, _, _, r, s) in log[:10]] and out[8] == [("user", "Q"), ("assistant", "new")] and out[None] == [("user", "n")]
    digest = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(events)).collect()}
    assert digest[8]["turns_sha256"] == hashlib.sha256(b"user\nQ\nassistant\nnew\n").hexdigest() and digest[7]["n_turns"] == 10
    assert chat.format_chats(events.limit(0)).count() == 0


# --- licenses


def test_licenses(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.license_labels(docs).collect()}
    rows = pairs(docs)
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, x) for i in range(len(w)) for p, x in licenses.BASE.items() if w[i : i + len(p.split())] == p.split()]
        r = got[d, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "mit-notice" in got[12, 16]["labels"]
    assert licenses.license_labels(docs).count() == len(rows) and licenses.license_labels(empty).count() == 0


def test_a_notice_with_more_conditions_is_no_notice_without_them(spark):
    texts = {
        "This work is licensed under CC BY-NC 4.0.": "cc-by-nc", "licensed under CC BY-SA 4.0": "cc-by-sa", "licensed under CC BY 4.0": "cc-by", "Licensed under CC-BY-NC-SA 4.0, all rights reserved": "cc-by-nc-sa,reserved",
        "licensed under cc by nd 4 0 licensed under cc by 4 0": "cc-by,cc-by-nd", "licensed under the really old cc by 4 0": "", "\u212ait license MIT License": "mit",
        "Redistribution and use in source and BINARY forms with or without any modification are permitted": "bsd-text", "mit mit license license": "mit",
    }
    got = {r["doc_id"]: r for r in licenses.license_labels(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(len(texts))] == [*texts.values()] and 0.7 <= got[7]["score"] < 1 == got[0]["score"]


# --- sharding and mixing


def test_sharding(spark, docs, empty, sf):
    for table_ in (docs, table(spark, sf, "documents")):
        rows = sharding.shard(table_).collect()
        assert len(rows) == table_.count()
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert collections.Counter(tuple(r)[:3] for r in sharding.shard(docs).collect()) == want
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) / min(load.values()) < 1.02
    assert sharding.shard(empty).count() == 0


def test_sharding_of_repeated_rows(spark):
    rows = sharding.shard(spark.createDataFrame([(1, "x" * 800)] * 500 + [(k, "y") for k in range(500)], "doc_id long, text string").repartition(4)).collect()
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(rows) == 1000 and max(load.values()) - min(load.values()) <= 802


def test_the_ring_moves_little():
    cells = [(k, 0, 0, 100 + k % 7) for k in range(sharding.CELLS)]
    eight, nine = sharding.settle(cells, 8), sharding.settle(cells, 9)
    moved = sum(a != b for a, b in zip(eight, nine)) / len(cells)
    between = sum(a != b != 8 for a, b in zip(eight, nine)) / len(cells)
    assert 1 / 9 - 0.01 < moved < 0.25 and between < 0.15


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | fixed
        fixed |= over


def test_mixing(spark, docs, empty, sf):
    for table_ in (docs, table(spark, sf, "documents")):
        rows = mixing.mixed(table_).collect()
        texts = collections.Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in pairs(table_))
        assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == texts
        sizes, taken = collections.Counter(), collections.Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 3 * r["size"]
        want = targets(sizes)
        for r in rows:
            assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        largest = collections.Counter()
        for r in rows:
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert mixing.mix(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


def test_mixing_by_brute_force(spark, docs):
    """Rows in order of their keys go in up to the budget, whatever the buckets are; rows may share id, key and all."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(k % 45, words(k % 9), f"s{k % 5}") for k in range(400)] + [(7, words(3), "s9")] * 300 + [(None, words(k % 4), None) for k in range(50)] + [(8, None, "s8"), (8, "", "s8")]
    table_ = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    keyed = table_.select("*", mixing.uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.col("text").cast("binary"))))).alias("u"), mixing.quality(F.coalesce("text", F.lit(""))).alias("q")).collect()
    by = collections.defaultdict(list)
    for r in keyed:
        by[r["source"]].append((-np.log(r["u"]) / r["q"], len((r["text"] or "").split()), r["doc_id"], r["text"]))
    want, taken, got = targets({s: sum(x[1] for x in v) for s, v in by.items()}), collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for r in mixing.mixed(table_).collect():
        got[r["source"], r["doc_id"], r["size"]][0] += r["copies"]
        taken[r["source"]] += r["taken"]
    for s, v in by.items():
        size = sum(x[1] for x in v)
        epochs = int(want[s] // size) if size else 1
        left, expected = want[s] - epochs * size, collections.Counter()
        for _, n, d, _ in sorted(v, key=lambda x: (x[0], x[1])):
            fits = left > 0 and n / 2 <= left
            expected[s, d, n] += epochs + fits
            left -= n
        assert {k: c[0] for k, c in got.items() if k[0] == s and k[2]} == {k: c for k, c in expected.items() if k[2]}
    mixed = collections.Counter((r["source"], r["doc_id"], len((r["text"] or "").split())) for r in mixing.mix(table_).collect())
    assert all(mixed[k] == c[0] for k, c in got.items())


def test_mix_of_one_id_in_two_sources(spark):
    rows = [(7, "a b c", "s0"), (7, "d e f", "s1")] + [(k, "w " * 30, "s0") for k in range(100, 130)]
    table_ = spark.createDataFrame(rows, "doc_id long, text string, source string")
    due = collections.Counter({(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mixed(table_).collect()})
    got = collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mix(table_).collect())
    assert got == collections.Counter({k: c for k, c in due.items() if c}) and due[7, "s1", 3] == 3


def test_operators_of_the_pipeline_keep_any_columns(spark, docs, empty, sf):
    for table_ in (docs, empty):
        for out in (mixing.mix(table_), personal.mask(table_), near_dedup.drop_near_duplicates(table_), quality.keep_good(table_, table(spark, sf, "labels"))):
            assert out.columns == table_.columns and out.where(" OR ".join(f"{c} <> 'x'" for c in CLASHING)).count() == 0


# --- classifier


def test_quality(spark, docs, empty):
    big = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.score(table(spark, big, "documents"), table(spark, big, "labels")).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    known = [(got[r["doc_id"]], r["quality"]) for r in table(spark, big, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([g["predicted"] == q for g, q in known]) > 0.93
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(15)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(docs, labels.limit(0)).where("score <> 0.5").count() == 0 and quality.score(empty, labels).count() == 0


def test_vote_by_brute_force():
    r = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v, known, labels = unit(r.standard_normal((300, 8))), unit(r.standard_normal((700, 8))), r.integers(0, 2, 700).astype(float)
    got = quality.vote(v, known, labels, 15)
    for x, s in zip(v, got):
        cosine = known @ x
        best = np.argsort(-cosine)[:15]
        w = np.maximum(cosine[best], 1e-6) ** 4
        assert s == pytest.approx((w * labels[best]).sum() / w.sum())


def test_quality_of_empty_and_repeated_texts(spark):
    rows = [(0, None), (1, "")] + [(2, "word " * 20)] * 5 + [(k, f"{WORDS[k]} {WORDS[k + 1]}") for k in range(3, 60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(10**6 + k, 1, 0) for k in range(6000)], "doc_id long, quality int, toxic int")
    table_ = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(table_, labels).collect()}
    space, vectors, known = quality.fit(table_, labels)
    assert got[0] == got[1] == 0 and len(known) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(2, 60))  # labels without a document take no place


def test_quality_of_long_labelled_texts(spark):
    texts = ["word " * 60_000, "x" * 250_000] + [f"{WORDS[k]} {WORDS[k + 1]} {k}" for k in range(30)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(32)], "doc_id long, quality int, toxic int")
    assert not any(zlib.crc32(str(k).encode()) % 3 == 1 for k in (0, 1))
    scored = quality.score(rows, labels).collect()
    assert len(scored) == 32 and all(0 <= r["score"] <= 1 for r in scored)


# --- searches


def vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 64)).round(3)
    x[100:160] = x[100]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1100, [0.0] * 64, 1), (1200, [float("nan")] * 64, 1), (1300, [None] * 64, 1), (1400, [float("inf")] * 64, 1), (1500, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), x.astype(np.float32)


def test_hamming(spark):
    v, x = vectors(spark)
    got = [tuple(r) for r in hamming.top_k(hamming.sign_codes(v), v.where("vec_id % 100 = 0")).collect()]
    bits, want = x > 0, []
    for q in range(0, 400, 100):
        d = sorted((int((bits[q] != bits[k]).sum()), k) for k in range(400) if k != q)[:20]
        want += [(q, i + 1, k, n) for i, (n, k) in enumerate(d)]
    assert sorted(got) == sorted(want)
    assert hamming.top_k(hamming.sign_codes(v.limit(0)), v).count() == 0


def test_hamming_ties(spark):
    """Far more different codes at one distance than k, several rows to a code, ids in no order of the codes."""
    rows = [(0, 0), (100, 3)] + [(2007 + 37 * i % 191, 1 << (i % 63)) for i in range(120)] + [(1000 + i, 3 << (i % 61)) for i in range(90)]
    codes = spark.createDataFrame(rows, "vec_id long, code0 long").repartition(7)
    got = [tuple(r) for r in hamming.top_k(codes, codes.where("vec_id in (0, 100)").select("vec_id"), 9).collect()]
    want = []
    for query, mine in [r for r in rows if r[0] in (0, 100)]:
        near = sorted(((mine ^ c).bit_count(), i) for i, c in rows if i != query)
        want += [(query, n + 1, i, d) for n, (d, i) in enumerate(near[:9])]
    assert sorted(got) == sorted(want)


def test_ann(spark):
    v, x = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x, hit = x.astype(float), []
    for q in range(0, 400, 20):
        s = x @ x[q]
        best = [k for k in sorted(range(400), key=lambda k: (-s[k], k)) if k != q][:20]
        assert len(got[q]) == 20 and all(abs(s[k] - score) < 1e-9 for k, score in got[q]) and got[q] == sorted(got[q], key=lambda p: (-round(p[1], 9), p[0]))
        hit.append(len({k for k, _ in got[q]} & set(best)) / 20)
    assert np.mean(hit) >= 0.9 and set(got) == set(range(0, 400, 20))
    assert ann.nearest(v.limit(0), v).count() == 0


def test_hamming_of_long_and_short_vectors(spark):
    r = np.random.default_rng(9)
    x = [r.standard_normal(n).round(2).tolist() for n in (130, 130, 100, 64, 3) for _ in range(30)]
    v = spark.createDataFrame([*enumerate(x)], "vec_id long, embedding array<double>")
    got = [tuple(t) for t in hamming.top_k(hamming.sign_codes(v), v.where("vec_id % 50 = 0"), 7).collect()]
    bits, want = [[k < len(e) and e[k] > 0 for k in range(192)] for e in x], []
    for q in range(0, 150, 50):
        d = sorted((sum(a != b for a, b in zip(bits[q], bits[k])), k) for k in range(150) if k != q)[:7]
        want += [(q, i + 1, k, n) for i, (n, k) in enumerate(d)]
    assert sorted(got) == sorted(want)


def test_ann_ties_and_lengths(spark):
    same = spark.createDataFrame([(k, [1.0, float(k % 7), float(k // 7)] if k else [1.0, 0.0, 0.0]) for k in range(301)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(same, same.where("vec_id = 0")).orderBy("rank").collect()] == [*range(1, 21)]
    rows = [(0, [1.0] + [0.0] * 63)] + [(k, [1.0] + [float(k * 7919 * (j + 1) % 101) for j in range(63)]) for k in range(1, 301)] + [(None, [2.0] + [1.0] * 63), (7, [9.0, 1.0]), (20, [5.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(v, spark.createDataFrame([(0,)], "vec_id long").union(spark.createDataFrame([(20,)], "vec_id long"))).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(None, 2.0)] + [(k, 1.0) for k in range(1, 20)] and got[20][0] == (7, 46.0)


def test_ann_recall(spark):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = v.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = collections.defaultdict(set)
    for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & found[ids[q]]) / 20)
    assert np.mean(hit) >= 0.95


def test_ann_queries_unlike_the_rows(spark):
    """Rows in clusters want few lists, the queries among them, without structure, want many."""
    r = np.random.default_rng(5)
    x = r.standard_normal((50, 32))[r.integers(0, 50, 4000)] + 0.05 * r.standard_normal((4000, 32))
    x[::20] = r.standard_normal((200, 32))
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for row in ann.nearest(v, v.where("vec_id % 20 = 0")).collect():
        found[row["query_id"]].add(row["vec_id"])
    hit = [len({k for k in np.argsort(-(x @ x[q])) if k != q and (x @ x[q])[k] >= np.sort(np.delete(x @ x[q], q))[-20]} & found[q]) / 20 for q in range(0, 4000, 200)]
    assert np.mean(hit) >= 0.95 and min(hit) >= 0.5


# --- personal data


def spans_of(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, text) if len(text) < 40_000 else ():
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, docs, empty, sf):
    for table_ in (docs, table(spark, sf, "documents")):
        rows = personal.personal_data(table_).collect()
        want = collections.Counter((d, hashlib.sha256(",".join(spans_of(t or "")).encode()).hexdigest()) for d, t in pairs(table_))
        assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in rows) == want
    assert personal.personal_data(empty).count() == 0
    masked = {r["doc_id"]: r["text"] for r in personal.mask(docs).collect()}
    assert masked[15] == "é" * 30 + " <email> <ip>" and masked[0] is None and personal.mask(docs).columns == docs.columns


def test_contexts_find_what_the_patterns_miss(spark):
    rows = [(k, f"please call me at +1 (212) 555-01{k:02d} today") for k in range(12)] + [(99, "please call me at 212/555/0199 today")]
    got = {r["doc_id"]: r["spans"] for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "context:18:30" and got[3].startswith("phone:18:35")


def test_contexts_reached_through_discovered_instances(spark):
    """``staff no`` has no seed; it scores only by ids that stand after ``call me`` too."""
    texts = [f"please call me +1 (212) 555-01{k:02d} today" for k in range(40)] + [f"please {p} 212444{k:02d} today" for k in range(8) for p in ("call me", "staff no")]
    rows = [*enumerate(texts), (99, "please staff no 99887766 today")]
    got = {r["doc_id"]: r["spans"] for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "context:16:24"


def test_contexts_of_keys(spark):
    """Long keys are seeds: what stands before them finds short ones, and masking takes both out."""
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(12)]
    texts = [f'bla {k} token = "{x}" bla' for k, x in enumerate(keys)] + ['bla token = "77aa8812" bla', "in the year 20177 bla", "pin: 112233 bla"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal.personal_data(docs).collect()}
    assert got[12] == "context:13:21" and got[13] == got[14] == "" and all(got[k] == f"context:{14 + len(str(k))}:{54 + len(str(k))}" for k in range(12))
    masked = {r["doc_id"]: r["text"] for r in personal.mask(docs).collect()}
    assert masked[12] == 'bla token = "<context>" bla' and masked[13] == texts[13]


def test_graph_scores_by_brute_force(spark):
    r = random.Random(6)
    ids = [f"{r.randrange(10**9):09d}" for _ in range(25)] + [f"+1 212 555 {r.randrange(10**4):04d}" for _ in range(25)] + [f"a{k}@b.co" for k in range(10)]
    befores = ["call me", "staff no", "my pin:", "his pin:", "of the", "in 0", "0 no:"]
    rows = [(r.choice(befores), r.choice(ids)) for _ in range(400)]
    seed = {x: float(x[0] == "+" or "@" in x) for x in ids}
    tokens = [{"pattern": p, "instance": x, "known": bool(seed[x]), "inside": False, "s": 0, "e": 1} for p, x in rows]
    found = spark.createDataFrame([([t],) for t in tokens], "_tokens array<struct<pattern:string,instance:string,known:boolean,inside:boolean,s:bigint,e:bigint>>")
    links = {(q, x) for p, x in rows for q in ([p] + [p.split()[-1]] * p.endswith(":"))}
    shape = lambda x: re.sub("[0-9]", "0", re.sub(r"[^0-9@.:/+() _-]+", "a", x))
    score = {x: seed[x] for _, x in links}
    mean = lambda v: sum(v) / (len(v) + personal.DOUBT)
    for _ in range(personal.ROUNDS):
        good = {p: mean([score[x] for q, x in links if q == p]) for p, _ in links}
        like = {s: personal.LIKENESS * mean([v for x, v in score.items() if shape(x) == s]) for s in map(shape, score)}
        score = {x: max(seed[x], like[shape(x)], max(good[p] for p, y in links if y == x)) for x in score}
    want = {p: pytest.approx(g) for p, g in good.items() if g >= personal.GOOD and len({x for q, x in links if q == p}) >= personal.SUPPORT}
    assert {x["pattern"]: x["score"] for x in personal._good_patterns(found).collect()} == want and want


def test_contexts_with_numbers_in_them(spark):
    texts = [f"user {4711 + k} call +1 (212) 555-01{k:02d}" for k in range(12)] + ["user 99 call 99887766", "user a@b.co call 99887766", "x" * 200 + " 1 call\n 99887766 " + "1 " * 600]
    got = {r["doc_id"]: r["spans"] for r in personal.personal_data(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got[12] == "context:13:21" and got[13] == "email:5:11" and got[14] == "context:209:217"


def test_two_words(spark):
    texts = [f"{a} " * k + f"Pin,\t\n{b} 7" for a in ("word", "12", "a@b", "é" * 300) for k in (0, 1, 2, 300) for b in ("No", "4711,", "@x")]
    texts += ["7", " 7", "a 7", "1 7", "1 2 7 8", " 1\n 2 @ x 7", "1 " * 700]
    mark = lambda w: "@" if "@" in w else "0" if re.search("[0-9]", w) else w.lower()
    want = []
    for t in texts:
        w = t.split()
        want.append([" ".join(map(mark, w[k - 2 : k])) if k > 1 else "" for k, x in enumerate(w) if re.search("[0-9@]", x)])
    df = spark.createDataFrame([*enumerate(texts)], "k int, t string")
    got = df.select("k", F.transform(personal.matches(F.col("t"), personal.TOKEN, True), lambda x: x["before"]).alias("b")).orderBy("k").collect()
    assert [r["b"] for r in got] == want


# --- pipeline


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == names
        if k == 0:
            good = {r["doc_id"] for r in quality.score(before, table(spark, sf, "labels")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == good
        if k == 1:
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(min(c) for c in classes(pairs(before)))
        if k == 2:
            assert personal.personal_data(docs).agg(F.sum("n_email") + F.sum("n_ip")).first()[0] == 0
        if k == 3:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(before).collect()}
            assert collections.Counter(r["doc_id"] for r in docs.collect()) == collections.Counter({d: c for d, c in copies.items() if c})
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_run(spark, sf):
    """run() against its stages' parts in plain Python: which documents it packs, and their token ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    texts = dict(p for p in pairs(docs) if p[0] in good)
    first = {min(c) for c in classes(texts.items())}
    kept = spark.createDataFrame([r for r in docs.collect() if r["doc_id"] in first], docs.schema)
    masked = {r["doc_id"]: r["text"] for r in personal.mask(kept).collect()}
    for d, t in masked.items():
        assert all(not s.startswith(("email", "ip")) for s in spans_of(t)) and (spans_of(texts[d]) or "context" in t or t == texts[d])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(personal.mask(kept)).collect()}
    tok, want = Tokenizer.from_file(registry.tokenizer()), collections.Counter()
    for d, t in masked.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            x = np.array(ids[s : s + 4096], "<u4")
            want[d, p, s, len(x), zlib.crc32(x.tobytes())] += copies[d]
    got = collections.Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect())
    assert got == collections.Counter({k: c for k, c in want.items() if c})
