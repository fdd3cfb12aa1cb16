"""Operators on small inputs with known results."""

import math
import os
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import depparse, evaluation, pcfg, segmentation, spelling, tagging
from glossa.operators.corpus import ordered_prefix, sentences
from glossa.sources.conllu import read_treebank
from glossa.streaming import editor

HERE = os.path.dirname(__file__)
SAID = ["our tide was low", "every morning brings new weather", "the gull flew over", "a gull of the harbour", "our gull was low"]


def value(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.fixture(scope="module")
def corpus(spark):
    return sentences(spark.createDataFrame([(k, s) for k, s in enumerate(SAID)], "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def tagged(spark):
    said = ["our/DET red/ADJ kite/NOUN soars/VERB", "one/DET gull/NOUN circles/VERB calmly/ADV", "our/DET kite/NOUN falls/VERB suddenly/ADV", "one/DET pale/ADJ gull/NOUN soars/VERB", "kites/NOUN drift/VERB gently/ADV"]
    return spark.createDataFrame([(k, [tuple(t.split("/")) for t in s.split()]) for k, s in enumerate(said)], "sent int, tokens array<struct<form:string,tag:string>>").cache()


@pytest.mark.parametrize("a,b,near", [("word", "word", True), ("word", "wrd", True), ("word", "wword", True), ("word", "ward", True), ("word", "wrod", True), ("hello", "he", False), ("ab", "cd", False), ("", "a", True)])
def test_within_one(spark, a, b, near):
    assert value(spark, T.within_one(F.lit(a), F.lit(b))) is near


def test_edits(spark):
    got = set(value(spark, T.edits1(F.lit("cat"))))
    assert {"at", "act", "bat", "cats", "cat"} <= got and len(got) == 182
    assert set(value(spark, T.edits1(F.lit("")))) == set("abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("word,has", [("quickly", "suf_ly pref_qu shape_all_lower"), ("Apple", "shape_capitalized"), ("2026", "shape_has_digit"), ("USA", "shape_all_caps"), ("a-b", "shape_has_hyphen")])
def test_word_features(spark, word, has):
    assert set(has.split()) <= set(value(spark, T.word_features(F.lit(word))))


@pytest.mark.parametrize("word,model,out", [("have", "Hav", "Have"), ("have", "HAV", "HAVE"), ("Have", "hav", "have")])
def test_restore_case(spark, word, model, out):
    assert value(spark, T.restore_case(F.lit(word), F.lit(model))) == out


def test_candidates_a_and_b_agree_and_equal_brute_force(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(150)})
    asked = sorted({"".join(r.choices("abcd", k=r.randint(1, 5))) for _ in range(60)})
    v = spark.createDataFrame([(w, 1) for w in words], "w string, c long")
    q = spark.createDataFrame([(w,) for w in asked], "q string")
    a, b = ({tuple(x) for x in f(q, v).collect()} for f in (spelling.candidates_a, spelling.candidates_b))

    def near(x, y):
        if abs(len(x) - len(y)) > 1:
            return False
        short, long_ = sorted((x, y), key=len)
        if len(x) != len(y):
            return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))
        return sum(p != s for p, s in zip(x, y)) < 2 or any(x[:i] + x[i + 1] + x[i] + x[i + 2 :] == y for i in range(len(x) - 1))

    assert a == b == {(x, y) for x, y in product(asked, words) if near(x, y)}


def test_realword_serial(spark):
    train = sentences(spark.createDataFrame([(k, s) for k, s in enumerate(["we will meet them here"] * 20 + ["they eat meat daily"] * 3)], "doc_id long, text string"))
    ask = spark.createDataFrame([(1, ["we", "will", "meat", "them"])], "id int, w array<string>")
    vocab = train.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    assert spelling.realword_serial(ask, train, vocab).first()["corrected"] == ["we", "will", "meet", "them"]


def test_decoder_is_optimal_on_short_sentences(tagged):
    d = tagging.Decoder(tagged)
    r = random.Random(1)
    for _ in range(40):
        words = r.choices(["our", "one", "kite", "gull", "soars", "green", "softly", "Oslo"], k=r.randint(1, 4))
        assert abs(d.score(words, tuple(d.decode(words))) - d.score(words, tuple(d.exhaustive(words)))) < 1e-9
    assert d.decode([]) == [] and d.decode(["our", "red", "kite", "soars"]) == ["DET", "ADJ", "NOUN", "VERB"]
    assert d.decode(["our", "kite", "soars", "softly"])[-1] == "ADV"


def test_decoder_takes_logarithms_of_the_c_library(spark):
    """Counts at which Spark's logarithm differs in the last bit."""
    said = [("x", "A")] * 3 + [("y", "A")] * 16 + [("z", "B")] * 12
    tagged = spark.createDataFrame([(k, [t]) for k, t in enumerate(said)], "sent int, tokens array<struct<form:string,tag:string>>")
    forms = spark.createDataFrame([("x",)], "form string")
    assert tagging.emission_scores(forms, tagged).first()["scores"] == {"A": math.log(3 / 19), "B": -25.0}
    assert tagging.Decoder(tagged).emit["x"] == {"A": math.log(3 / 19)}
    assert tagging.Chain(tagged).trans["<s>", "<s>", "A"] == math.log((19 + 0.1) / (31 + 0.1 * 2))


def test_segmentation_by_joined_counts(spark, corpus):
    texts = ["ourtidewaslow", "everymorningbrings", "zzourq", "Our tideWasLow", "", None, "a", "lowourtideevery"]
    rows = spark.createDataFrame([*enumerate(texts)], "k int, text string")
    whole, part = segmentation.Model(corpus), segmentation.Model(corpus, rows)
    assert [part.segment(t or "") for t in texts] == [whole.segment(t or "") for t in texts]
    assert (part.total, part.types, part.longest) == (whole.total, whole.types, whole.longest) and len(part.tri) <= len(whole.tri)
    got = segmentation.segmented(rows, "text", corpus).orderBy("k").collect()
    assert [r["words"] for r in got] == [whole.segment(t or "") for t in texts]


def test_training_takes_long_documents(spark, tmp_path):
    from glossa.plans import catalog

    texts = ["thesevere storms " * 5, "the severe " * 300]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "severe the")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["words"] for r in catalog.viterbi_segment(spark, str(tmp_path)).collect()] == ["severe the"]


def test_long_lines_are_segmented(spark, tmp_path):
    from glossa.plans import catalog

    spark.createDataFrame([(1, "the severe storms " * 20, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the severe storms " * 10)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["words"] for r in catalog.viterbi_segment(spark, str(tmp_path)).collect()] == [("the severe storms " * 10).strip()]


def test_long_lines_are_parsed(spark, tmp_path):
    from glossa.plans import catalog

    said = "meet " + "at " * 39 + "the"  # longer than 40 words
    spark.createDataFrame([(1, said)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["key"] for r in catalog.cky_parse(spark, str(tmp_path)).collect()] == ["1:1"]
    for f in (catalog.oracle_transitions, catalog.dep_features):
        assert {r["key"] for r in f(spark, str(tmp_path)).collect()} == {"1:1"}
    arcs = [r["transition"] for r in catalog.oracle_transitions(spark, str(tmp_path)).collect()]
    assert sum(not x.upper().startswith("SH") for x in arcs) >= 41  # one arc a word


def test_rare_words_are_proposed(spark, tmp_path):
    from glossa.plans import catalog

    spark.createDataFrame([(1, "we will meet them\n" * 5 + "a meat pie\n" * 5, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "we will meat them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert catalog.realword_correct(spark, str(tmp_path)).first()["corrected"] == ["we", "will", "meet", "them"]


def test_segmentation(spark, corpus):
    m = segmentation.Model(corpus)
    assert m.segment("ourtidewaslow") == ["our", "tide", "was", "low"] and m.segment("") == []
    assert m.segment("everymorningbrings") == ["every", "morning", "brings"]
    assert "".join(m.segment("zzourq")) == "zzourq"
    assert segmentation.greedy("oarqvwnet", {"oar", "net"}, 3) == ["oar", "q", "v", "w", "net"]
    out = segmentation.typing_merges(corpus, ["doc_id", "line"], 0.5)
    text = {r[0]: r[1] for r in out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")).collect()}
    assert text == {k: s.replace(" ", "") for k, s in enumerate(SAID)}
    assert segmentation.typing_merges(corpus, ["doc_id", "line"], 0.0).count() == sum(len(s.split()) for s in SAID)


def test_oracle_and_parser(spark):
    moves = depparse.oracle([2, 3, 0], ["amod", "nsubj", "root"], ["Red", "kites", "soar"], ["ADJ", "NOUN", "VERB"])
    assert [m[-1] for m in moves] == ["SHIFT", "SHIFT", "LEFT-ARC:amod", "SHIFT", "LEFT-ARC:nsubj", "RIGHT-ARC:root"]
    state = depparse.State(2)
    state.apply("LEFT-ARC:x")
    assert state.stack == [0] and not state.arcs
    crossing = depparse.oracle([3, 4, 0, 3], ["a"] * 4, list("wxyz"), list("ABCD"))
    assert crossing[-1][-1].startswith("RIGHT-ARC")
    token = lambda i, f, u, h, d: {"id": i, "form": f, "upos": u, "head": h, "deprel": d}
    trees = spark.createDataFrame(
        [(k, [token(1, "Red", "ADJ", 2, "amod"), token(2, n, "NOUN", 3, "nsubj"), token(3, "soar", "VERB", 0, "root")]) for k, n in enumerate(["kites", "gulls", "larks"])],
        "key int, tokens array<struct<id:int,form:string,upos:string,head:int,deprel:string>>",
    )
    model = depparse.Classifier(depparse.transitions(trees, "key"), 50)
    assert depparse.parse(model, ["Red", "herons", "soar"], ["ADJ", "NOUN", "VERB"]) == [(2, "amod", 1), (3, "nsubj", 2), (0, "root", 3)]
    gold = trees.select("key", F.inline("tokens")).select("key", F.col("id").alias("dep"), "head", F.col("deprel").alias("label"))
    got = depparse.parsed(trees, model).select("key", F.inline("arcs")).select("key", "dep", "head", "label")
    assert tuple(evaluation.attachment(gold, got, "key").first()) == (9, 1.0, 1.0)


def test_grammar(spark):
    assert pcfg.normal_form(["S", ["A", ["B", ["C", "x"]]], ["D", "y"], ["E", "z"]]) == ["S", ["A+B", ["C", "x"]], ["S|<D-E>", ["D", "y"], ["E", "z"]]]
    rules = [("S", ["NP", "VP"], False, 1.0), ("NP", ["DT", "NN"], False, 1.0), ("VP", ["VB"], False, 1.0), ("DT", ["one"], True, 1.0), ("NN", ["kite"], True, 0.5), ("NN", ["gull"], True, 0.5), ("VB", ["soars"], True, 1.0)]
    p = pcfg.Parser(rules)
    assert p.parse("one kite soars".split()) == {"tree": "(S (NP (DT one) (NN kite)) (VP (VB soars)))", "logp": pytest.approx(-0.6931, abs=1e-3), "status": "parsed"}
    assert p.parse(["one", "heron", "soars"], ["DT", "NN", "VB"])["status"] == "parsed"
    assert p.parse([])["status"] == "empty" and p.parse(["kite", "one"])["status"] == "unparseable"
    assert value(spark, F.size(pcfg.split_sentences(F.lit("One. Two! Three? Four")))) == 4


def test_treebank(spark):
    rows = read_treebank(spark, f"{HERE}/fixtures/mini.conllu").orderBy("sent").collect()
    assert [[t["form"] for t in r["tokens"]] for r in rows] == [["Red", "kites", "soar"], ["di", "la"]]
    assert rows[0]["text"] == "Red kites soar" and rows[1]["tokens"][0]["head"] == 0
    assert value(spark, tagging.feats_tag(F.lit("NOUN"), F.lit(rows[0]["tokens"][1]["feats"]))) == "NOUN-Masc-Sing"


def test_ordered_prefix(spark):
    rows = spark.createDataFrame([(i * i,) for i in range(37)], "id long")
    assert sorted(r[0] for r in ordered_prefix(rows, "id", 0.8).collect()) == [i * i for i in range(29)]


def test_stream_equals_replay(spark, tmp_path):
    train = sentences(spark.createDataFrame([(k, s) for k, s in enumerate(["here lies a calm harbour beside mountains", "they love to paint a calm harbour"] * 3)], "doc_id long, text string"))
    language = editor.Language(train)
    said = {"a": "herelies a calm harbuor beside mountains they love".split(), "b": "they love to paimt a calm harbour beside it".split()}
    rows = [(k, i, t) for k, ts in said.items() for i, t in enumerate(ts)]
    tokens = spark.createDataFrame(rows, "key string, seq long, token string")
    replay = sorted(map(str, editor.replayed_alerts(tokens, language).collect()))
    assert any("SEGMENT" in x for x in replay) and any("SPELL" in x and "'harbour'" in x for x in replay)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] > 4) == bool(part)], tokens.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = editor.live_alerts(stream, language).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.sql("select * from alerts").collect())) == replay


def test_editor_asks_only_what_it_needs(spark, monkeypatch):
    """More n-grams than may be collected train the editor, and it says what the whole language says."""
    from glossa.operators import corpus, lm

    r = random.Random(4)
    train = spark.createDataFrame([(k, s.split()) for k, s in enumerate(SAID * 3 + [" ".join(r.choices("gulls gull tide tides low law new now our out brings morning weather over every".split(), k=8)) for _ in range(40)])], "k int, w array<string>")
    typed = [(str(k), i, w) for k in range(6) for i, w in enumerate(r.choices("our tid tdie was lwo everymorning brings nwe weather gulflew over harbour ourgull low law lavv now".split(), k=17))]
    tokens = spark.createDataFrame(typed, "key string, seq long, token string")
    want = sorted(map(str, editor.replayed_alerts(tokens, editor.Language(train)).collect()))
    triples = lm.counts(train, 3, 2).count()
    monkeypatch.setattr(corpus.collected, "__defaults__", (triples - 1,))
    with pytest.raises(ValueError):
        editor.Language(train)
    monkeypatch.setattr(corpus.collected, "__defaults__", (10_000,))
    got = sorted(map(str, editor.replayed_alerts(tokens, editor.language_for(tokens, lm.Tables(train, corpus.stored))).collect()))
    assert got == want and {"SPELL", "GRAMMAR"} <= {b for b in ("SPELL", "GRAMMAR", "SEGMENT") if any(b in g for g in got)}


def test_corruption_tries_deletions_before_replacements(spark):
    vocab = ["gull", "ull", "gul", "tide", "ide", "tie", "abc", "bc", "ac", "ab", "aaa", "aa", "baa"]
    known = set(vocab)
    got = {r["w"]: r["wrong"] for r in spelling.corrupted(spark.createDataFrame([(w,) for w in vocab], "w string")).collect()}
    tries = lambda w: [w[:i] + w[i + 1 :] for i in range(len(w))] + [w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in T.LETTERS]
    assert got == {w: next(x for x in tries(w) if x not in known) for w in vocab if len(w) > 2}


def test_long_sentences_are_tagged_as_short_ones(spark):
    """A sentence of 3,000 words: the decoder copies no path, and its words' scores are joined once for each word."""
    tagged = spark.createDataFrame([([("a", "X"), ("b", "Y"), ("a", "Y")],), ([("b", "X"), ("B", "Y")],)], "tokens array<struct<form:string,tag:string>>")
    words = ["a", "b", "B"] * 1000
    got = tagging.viterbi(spark.createDataFrame([(words,)], "w array<string>"), tagged).first()["tags"]
    assert got == tagging.Decoder(tagged).decode(words) and len(got) == 3000
