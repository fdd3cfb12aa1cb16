"""Passage analysis, sentence correction, shared model tables, loaders and sinks on small inputs."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import analysis, depparse, evaluation, lm, pcfg, segmentation, spelling, tagging
from glossa.operators.corpus import sentences
from glossa.sources import corpora
from glossa.sources.conllu import read_treebank, tagged_sentences

HERE = os.path.dirname(__file__)
SAID = ["the harbour lies calm", "they paint the calm harbour", "we will meet them here", "they eat meat daily", "the harbour lies beside the sea"] * 4
TAGGED = ["our/DT red/JJ kite/NN soars/VBZ", "one/DT gull/NN circles/VBZ calmly/RB", "our/DT kite/NN falls/VBZ", "gulls/NNS drift/VBP"]
GRAMMAR = [("S", ["NP", "VBZ"], False, 0.5), ("S", ["S", "RB"], False, 0.5), ("NP", ["DT", "NN"], False, 0.7), ("NP", ["DT", "NX"], False, 0.3), ("NX", ["JJ", "NN"], False, 1.0), ("NN", ["kite"], True, 0.6), ("NN", ["gull"], True, 0.4)]


@pytest.fixture(scope="module")
def train(spark):
    return sentences(spark.createDataFrame([*enumerate(SAID)], "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def tagged(spark):
    return spark.createDataFrame([(k, [tuple(t.split("/")) for t in s.split()]) for k, s in enumerate(TAGGED)], "sent int, tokens array<struct<form:string,tag:string>>").cache()


def test_joined_emissions_give_the_tags_of_the_decoder(spark, tagged):
    said = [["our", "kite", "soars"], ["Green", "herons", "glide", "softly"], [], ["one"], ["..."], ["our", "kite", "soars"], None]
    rows = spark.createDataFrame([*enumerate(said)], "k int, w array<string>")
    d = tagging.Decoder(tagged)
    got = {r["k"]: r["tags"] for r in tagging.viterbi(rows, tagged).collect()}
    assert got == {k: d.decode(w or []) for k, w in enumerate(said)}


def test_passages(spark, train, tagged):
    """Every part of a sentence's row against the same part computed by hand."""
    texts = ["Our red kite soars. The harbour lies calm! ... One gull", "Our kite falls calmly? they meat", "!!", None]
    passages = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    grammar = spark.createDataFrame(GRAMMAR, "lhs string, rhs array<string>, lexical boolean, p double")
    alerts = spark.createDataFrame([(0, "SEGMENT", ["red", "zzz"]), (0, "SEGMENT", ["no"]), (0, "SPELL", ["calm"]), (1, "SPELL", ["OUR"]), (1, "GRAMMAR", ["our"])], "id long, badge string, replacement array<string>")
    got = {(r["id"], r["sentence_idx"]): r for r in analysis.analysed(passages, "id", tagged, grammar, train, alerts).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 4), (1, 1), (1, 2)}
    decoder, parser = tagging.Decoder(tagged), pcfg.Parser(GRAMMAR)
    uni = {r["w"]: r["c"] for r in lm.Tables(train).marked.collect()}
    bi = {(r["w1"], r["w2"]): r["c"] for r in lm.Tables(train).pairs.collect()}
    tri = {(r["w1"], r["w2"], r["w3"]): r["c"] for r in lm.Tables(train).triples.collect()}
    total = sum(c for w, c in uni.items() if w != "<s>")
    for r in got.values():
        words = re.findall(r"\b[A-Za-z0-9'-]+\b", r["sentence_text"])
        tags = [t if t in tagging.PENN else "NN" for t in decoder.decode(words)]
        parse = parser.parse(words, tags)
        low = ["<s>", "<s>", *(w.lower() for w in words), "</s>"]
        bigram = sum(math.log((bi.get(p, 0) + 0.05) / (uni.get(p[0], 0) + 0.05 * len(uni))) for p in zip(low[1:], low[2:]))
        trigram = 0.0
        for a, b, c in zip(low, low[1:], low[2:]):
            known = c in uni
            p = 0.14 * uni.get(c, 0) / total + 0.01 / (len(uni) - 2) + (0.25 * bi.get((b, c), 0) / uni[b] if uni.get(b) else 0) + (0.6 * tri.get((a, b, c), 0) / bi[a, b] if (a, b) in bi else 0)
            trigram += math.log(p) - (0 if known else 3 + 1.2 * len(c))
        n = len(words)
        if parse["status"] == "parsed" and parse["logp"] / n >= -11:
            verdict = "Grammatical (Valid Structure)"
        elif trigram / n >= -6.8:
            verdict = "Grammatical (Fluent Local Sequence)"
        elif parse["status"] == "partial_parse" or bigram / n >= -7.8:
            verdict = "Marginally Grammatical"
        else:
            verdict = "Likely Ungrammatical / Outlier"
        assert (r["pcfg_status"], r["pcfg_tree"], r["final_verdict"]) == (parse["status"], parse["tree"], verdict)
        assert r["bigram_logp"] == pytest.approx(bigram) and r["trigram_logp"] == pytest.approx(trigram) and (parse["logp"] is None or r["pcfg_logp"] == pytest.approx(parse["logp"]))
    count = lambda k: (got[k]["merges_resolved"], got[k]["spelling_corrections"])
    assert count((0, 1)) == (1, 0) and count((0, 2)) == (0, 1) and count((1, 1)) == (0, 1) and got[0, 1]["pcfg_status"] == "parsed"


def test_sentences_are_corrected_in_two_steps(spark, train):
    vocab = lm.Tables(train).words
    said = ["Teh harbor, lies CLAM!", "we will meat them here", "", None, "  they   paintt ... 42 the sae.", "we will meat them here"]
    rows = spark.createDataFrame([*enumerate(said)], "k int, said string")
    got = {r["k"]: r for r in spelling.corrected_sentences(rows, "said", train, vocab).collect()}
    assert got[0]["corrected"] == "The harbour, lies CALM!" and [tuple(c) for c in got[0]["changes"]] == [("Teh", "The"), ("harbor,", "harbour,"), ("CLAM!", "CALM!")]
    assert got[1]["corrected"] == got[5]["corrected"] == "we will meet them here" and got[2]["corrected"] == got[3]["corrected"] == ""
    assert got[4]["corrected"] == "they paint ... 42 the sea."
    shown = spark.createDataFrame([got[1]]).select(spelling.highlighted(F.col("corrected"), F.col("changes"))).first()[0]
    assert shown == "we will **meet** them here"


def test_realword_serial_on_repeated_rows(spark, train):
    ask = spark.createDataFrame([(1, ["we", "will", "meat", "them"])] * 3 + [(2, [])], "id int, w array<string>")
    got = [tuple(r["corrected"]) for r in spelling.realword_serial(ask, train, lm.Tables(train).words).collect()]
    assert sorted(got) == [(), *[("we", "will", "meet", "them")] * 3]


def test_candidates_without_verification(spark):
    v = spark.createDataFrame([(w,) for w in ["harbour", "abcd", "ab"]], "w string")
    q = spark.createDataFrame([(w,) for w in ["harbor", "harbuor", "bacd", "abxy", "ba"]], "q string")
    got = {tuple(r) for r in spelling.candidates_unverified(q, v).collect()}
    assert got == {("harbor", "harbour"), ("harbuor", "harbour"), ("bacd", "abcd"), ("ba", "ab")}


def test_models_on_disk(spark, train, tmp_path):
    corpora.build_models(train, str(tmp_path / "m"))
    held = corpora.load_models(spark, str(tmp_path / "m"))
    pairs = spark.createDataFrame([("the", "harbour"), ("<s>", "zz"), ("zz", "the")], "w1 string, w2 string")
    rows = lambda t: sorted((r["w1"], r["w2"], round(r["logp"], 9)) for r in lm.addk_scores(pairs, t).collect())
    assert rows(held) == rows(train) and spark.read.parquet(str(tmp_path / "m/index")).count() > 0


def test_ordered_loading(spark):
    rows = spark.createDataFrame([(k, [f" w{k} ", "", "X", "7"]) for k in range(50)], "id long, w array<string>").repartition(4)
    head, rest = corpora.split(rows, "id", 0.8, 20)
    assert sorted(r["id"] for r in head.collect()) == [*range(16)] and sorted(r["id"] for r in rest.collect()) == [16, 17, 18, 19]
    assert corpora.tidy(rows, 3).first()["w"][1:] == ["X", "7"] and corpora.tidy(rows, 1, True).first()["w"] == ["x"]
    assert [r["w"] for r in corpora.words_after(corpora.tidy(rows), "id", 3, 4).collect()] == ["w3", "X", "7", "w4"]


def test_treebank_options(spark, tmp_path):
    path = f"{HERE}/fixtures/mini.conllu"
    rooted = read_treebank(spark, path, root=True).orderBy("sent").collect()
    assert [t["form"] for t in rooted[0]["tokens"]] == ["<ROOT>", "Red", "kites", "soar"] and rooted[0]["tokens"][2]["lemma"] == "kite"
    assert read_treebank(spark, path, max_sentences=1).count() == 1 and read_treebank(spark, path, columns=9, exact=True).count() == 0
    pairs = tagged_sentences(read_treebank(spark, path), morphology=True, plain=True, fewest=3).first()["tokens"]
    assert [tuple(t) for t in pairs][1] == ("kites", "NOUN-Masc-Sing")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_treebank(spark, str(tmp_path / "none")).count()
    big = "".join(f"# sent_id = {k}\n1\tw{k}\tw\tX\t_\t_\t0\troot\t_\t_\n\n" for k in range(5000))
    (tmp_path / "big.conllu").write_text(big)
    assert [r["sent_id"] for r in read_treebank(spark, str(tmp_path / "big.conllu")).orderBy("sent").collect()] == [str(k) for k in range(5000)]


def test_sinks(spark):
    errors = spark.createDataFrame([("A", "B", 3), ("B", "A", 1), ("C", "A", 2)], "gold string, pred string, n long")
    table = evaluation.confusion_markdown(errors)
    assert table.splitlines()[2:] == ["| A | 0 | 3 | 0 |", "| B | 1 | 0 | 0 |", "| C | 2 | 0 | 0 |"] and evaluation.confusion_markdown(errors.limit(0)) == "No errors."
    assert evaluation.error_shares(spark.createDataFrame([(5, 1, 3), (5, 0, 0)], "correct long, genuine long, segmentation long")).select("genuine_pct").collect() == [(25.0,), (0.0,)]
    tokens = spark.createDataFrame([(1, [(1, "Red", "JJ"), (2, "kites", "NN")], [(2, "amod", 1), (9, "dep", 2)])], "k int, tokens array<struct<id:int,form:string,upos:string>>, arcs array<struct<head:int,label:string,dep:int>>")
    lines = [r["line"] for r in depparse.tree_lines(tokens, "k").orderBy("dep").collect()]
    assert lines[0].split() == ["1", "Red", "JJ", "2", "kites", "amod"] and lines[1].split() == ["2", "kites", "NN", "9", "<UNK>", "dep"]


def test_baseline_tags_of_unseen_words(spark, tagged):
    forms = spark.createDataFrame([("Kite",), ("zebra",)], "form string")
    assert {r["form"]: r["tag"] for r in tagging.baseline_tags(forms, tagged).collect()} == {"Kite": "NN", "zebra": "DT"}
    assert {r["tag"] for r in tagging.baseline_tags(forms, tagged.limit(0)).collect()} == {"NOUN"}


def test_distance_of_any_size(spark):
    pairs = [("harbour", "harbuor", 1), ("kitten", "sitting", 3), ("", "abc", 3), ("ca", "abc", 3), ("abcdef", "abcdef", 0), ("ab", "ba", 1), (None, "a", None)]
    rows = spark.createDataFrame(pairs, "a string, b string, n int")
    assert rows.select((T.osa_distance(F.col("a"), F.col("b")).eqNullSafe(F.col("n"))).alias("ok")).where("NOT ok").count() == 0


def test_variants_of_the_decoders(spark, train):
    m = segmentation.Model(train)
    assert m.segment("theharbourlies", None, True) == ["the", "harbour", "lies"] and m.segment("theqharbour", None, True) == [] and m.segment("theqharbour")[1] == "q"
    assert segmentation.greedy("NetOar", {"net", "oar"}, 20) == ["Net", "Oar"] and segmentation.greedy("NetOar", {"net", "Oar"}, 20, True) == ["N", "e", "t", "Oar"]

    class Stubborn:
        def ranked(self, names, stack, buffer):
            return ["LEFT-ARC:x", "SHIFT", "RIGHT-ARC:y"]

    assert depparse.parse(Stubborn(), ["a", "b"], ["A", "B"], repair=False) == []
    assert depparse.parse(Stubborn(), ["a", "b"], ["A", "B"]) == [(2, "x", 1), (0, "y", 2)]


def test_misspelt_words(spark, train):
    v = lm.Tables(train).words
    got = {r["w"]: r["wrong"] for r in spelling.misspelt(v, v, 5).collect()}
    known = {r["w"] for r in v.collect()}
    assert len(got) == 5 and not set(got.values()) & known and got == {r["w"]: r["wrong"] for r in spelling.misspelt(v, v, 5).collect()}
