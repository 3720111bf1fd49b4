"""Tokens, packing, mixing and languages."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import languages as L
from strandloom.llm.mixing import mix
from strandloom.llm.packing import OpenBins, cut_documents, fill_report, pack
from strandloom.llm.tokens import VOCABULARY, Tokenizer, with_tokens

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b", "a   b", "a    b ", "\n", "x\n\n y", "a \n b", "tab\tand nbsp", "déjà vu", "déjà", "a" * 5000, "word " * 3000, "don't we'll", "x  \n\n  y", "█████ [...] «q»", "1 234,56  €", "  lead", " em"]


def test_token_counts_are_the_tokenizers(spark):
    t = Tokenizer.at(VOCABULARY)
    texts = ODD + [r.text for r in spark.read.parquet(DOCS).select("text").collect()]
    rng = random.Random(0)
    texts += ["".join(rng.choice(["a", "B1", " ", "  ", "\n", ".", "é", "12", "'s", "—", "\t"]) for _ in range(40)) for _ in range(300)]
    want = [len(t.encode(x)) if x else 0 for x in texts]
    assert t.counts(pa.array(texts, pa.string())).tolist() == want
    assert t.counts(pa.array([], pa.string())).tolist() == []
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    assert {r.i: r.n for r in with_tokens(df, "text", "n", ["i"]).collect()} == dict(enumerate(want))


def test_open_bins_are_best_fit_and_bounded():
    rng = random.Random(1)
    bins, free, open_ = OpenBins(100, 8), {}, set()
    for _ in range(3000):
        size = rng.randint(1, 100)
        fitting = [free[b] for b in open_ if free[b] >= size]
        fullest = min((free[b] for b in open_), default=None)
        was = set(open_)
        b = bins.put(size)
        if fitting:
            assert free[b] == min(fitting)
        else:
            assert b not in free
            if len(was) == 8:
                gone = next(x for x in was if free[x] == fullest and x not in {y for v in bins.by_free.values() for y in v})
                open_.discard(gone)
            free[b] = 100
            open_.add(b)
        free[b] -= size
        assert free[b] >= 0
        if free[b] == 0:
            open_.discard(b)
        assert len(open_) <= 8 and open_ == {y for v in bins.by_free.values() for y in v}


def docs(spark):
    rows = [(i, "word " * n, "x", 1) for i, n in enumerate([10, 400, 900, 100, 100, 2500, 100, 50, 30, 1000] * 20)]
    rows += [(1000 + i, t, "x", 1) for i, t in enumerate(ODD)] + [(0, "word " * 10, "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, container_id string, n_tokens int")


def test_packing_keeps_all_and_cuts_only_the_large(spark):
    df = docs(spark).repartition(3).cache()
    out = pack(df, 1000, open_bins=16).cache()
    size = {(r.doc_id, r.text): 0 for r in df.collect()}
    sizes = {r.doc_id: r.n for r in with_tokens(df, "text", "n", ["doc_id"]).dropDuplicates(["doc_id"]).collect()}
    got = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.max("n_pieces").alias("p"), F.sum((F.col("piece_no") == 0).cast("int")).alias("rows")).collect()
    assert len(size) == len(got) == 224 and sum(r.rows for r in got) == 225
    for r in got:
        assert r.t == sizes[r.doc_id] * r.rows and r.p == max(1, -(-sizes[r.doc_id] // 1000))
    assert {r.doc_id for r in cut_documents(out).collect()} == {k for k, v in sizes.items() if v > 1000}
    assert out.where("container_id IS NULL AND n_tokens > 0 OR container_id IS NOT NULL AND n_tokens = 0").isEmpty()
    filled = fill_report(out, 1000)
    assert filled.where("free_tokens < 0").isEmpty()
    assert filled.agg(F.sum("used_tokens") / (1000 * F.count("*"))).head()[0] > 0.8
    assert pack(df.where("false"), 10).collect() == []


def test_packing_needs_a_capacity(spark):
    with pytest.raises(ValueError):
        pack(docs(spark), 0)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeat int")


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.randint(20, 200)), s, 1) for i, s in enumerate(["Big "] * 600 + ["mid"] * 120 + ["small"] * 12 + [None] * 40 + ["other"] * 20)]
    rows += [(900, None, "mid", 1), (901, "", "small", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, block int")
    m = mix(df, targets(spark, [("big", 0.5, 2), (" MID", 0.4, 9), ("small", 0.1, 3), ("none", None, 5), (None, 0.3, 1)]), block_tokens=500)
    rep = {r.source: r for r in m.report.collect()}
    assert set(rep) == {"big", "mid", "small", "none"}
    n = {r.doc_id: r.n for r in with_tokens(df, "text", "n", ["doc_id"]).collect()}
    assert rep["big"].tokens == sum(n[i] for i, _, s, _ in rows if s == "Big ")
    assert abs(rep["mid"].slots_wanted / sum(r.slots_wanted for r in rep.values()) - 0.4) < 0.02
    assert rep["small"].out_of_reach and rep["small"].slots_missing > 0 and not rep["big"].out_of_reach and rep["big"].slots_missing == 0
    uses = {r.doc_id: r["count"] for r in m.plan.groupBy("doc_id").count().collect()}
    limit = {"Big ": 2, "mid": 9, "small": 3}
    source = {i: s for i, _, s, _ in rows}
    assert all(uses[d] <= limit[source[d]] for d in uses) and not any(source[d] in (None, "other") for d in uses)
    sums = {r.source: r.t for r in m.plan.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert all(sums.get(s, 0) == r.mixed_tokens for s, r in rep.items())
    assert m.plan.groupBy("doc_id", "repeat_no").count().where("count > 1").isEmpty()


def test_mix_counts_texts_longer_than_a_block(spark):
    rows = [(i, " ".join(["word"] * (1500 if i < 60 else 30)), "long" if i < 60 else "short") for i in range(3060)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    m = mix(df, targets(spark, [("long", 0.2, 5), ("short", 0.8, 5)]), block_tokens=500)
    rep = {r.source: r for r in m.report.collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.02 and r.slots_missing == 0 for r in rep.values())
    sums = {r.source: r.t for r in m.plan.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert sums == {s: r.mixed_tokens for s, r in rep.items()}


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    m = mix(none, targets(spark, [("a", 1.0, 1)]))
    assert [(r.source, r.mixed_tokens, r.out_of_reach) for r in m.report.collect()] == [("a", 0, False)] and m.plan.collect() == []
    some = spark.createDataFrame([(1, "x y", "a")], "doc_id bigint, text string, source string")
    assert mix(some, targets(spark, [])).report.collect() == []


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"))


def test_labels(spark):
    names = ["de", "DE", "de_DE", "de-AT", "ger", "deu", "German", " german ", "en-GB", "und", "??", "", None, "xx", "dut", "Spanish"]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    assert [r[0] for r in df.select(L.label_code("lang")).collect()] == ["de"] * 8 + ["en"] + [None] * 5 + ["nl", "es"]


# Sentences for the test, written for it.
HELD_OUT = {
    "en": "The landlord has never answered the letter in which the tenants asked for the repair of the heating.",
    "de": "Der Vermieter hat auf das Schreiben der Mieter, in dem sie um die Reparatur der Heizung baten, nie geantwortet.",
    "fr": "Le propriétaire n'a jamais répondu à la lettre dans laquelle les locataires demandaient la réparation du chauffage.",
    "es": "El propietario nunca contestó a la carta en la que los inquilinos pedían la reparación de la calefacción.",
    "it": "Il proprietario non ha mai risposto alla lettera con la quale gli inquilini chiedevano la riparazione del riscaldamento.",
    "nl": "De verhuurder heeft nooit geantwoord op de brief waarin de huurders om herstel van de verwarming vroegen.",
}


def test_model_is_right_on_held_out_text(spark, model):
    assert model.accuracy > 0.995 and 0.4 <= model.threshold <= 0.95
    s = L.sentences(pa.array(list(HELD_OUT.values())))
    p = model.sentence_probabilities(s)
    assert [model.languages[i] for i in p.argmax(axis=1)] == list(HELD_OUT)
    rest = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 1")
    parts = L.segments(rest, model, lang_col="lang").where("label IS NOT NULL AND lang IS NOT NULL").groupBy("doc_id", "label").agg(F.max_by("lang", "n_words").alias("lang"))
    assert parts.where(F.col("label").isin(model.languages)).agg(F.avg((F.col("label") == F.col("lang")).cast("int"))).head()[0] > 0.9  # labels themselves are partly wrong


def test_training_keeps_rare_languages_and_survives_long_texts(spark):
    rng = random.Random(4)

    def text(lang, n):
        return " ".join(" ".join([w[0].upper() + w[1:] for w in rng.sample(HELD_OUT[lang].split(), 1)] + rng.sample(HELD_OUT[lang].rstrip(".").lower().split(), 9)) + "." for _ in range(n))

    rows = [(text("en", 6), "en") for _ in range(1500)] + [(text("de", 6), "de") for _ in range(30)] + [(text("fr", 400), "fr") for _ in range(8)]
    m = L.train(spark.createDataFrame(rows, "text string, lang string"), sample_rows=90, max_chars=60_000)
    assert set(m.languages) == {"en", "de", "fr"}
    only = L.train(spark.createDataFrame([(text("en", 600), "en")] * 1, "text string, lang string"), max_chars=20_000)
    assert only.languages == ["en"]


def test_mixed_and_odd_documents(spark, model):
    en, de, fr = (" ".join([HELD_OUT[k]] * 3) for k in ("en", "de", "fr"))
    rows = [(1, f"{en}\n[2] {HELD_OUT['de']} {HELD_OUT['de']}\n[3] {en}", "en", 1), (2, f"{fr} «Nein.» {fr}", "FR", 1), (3, fr, None, 1), (4, None, "de", 1), (5, "", "de", 1), (6, " \n ", "de", 1), (7, "12.3 45 — 7/8", "de", 1), (8, de * 200, "it", 1), (9, de, "German", 1), (9, de, "German", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, segment int")
    parts = L.segments(df, model, lang_col="lang", with_text=True).cache()
    assert [(r.lang, r.n_sentences) for r in parts.where("doc_id = 1").orderBy("segment").collect()] == [("en", 3), ("de", 2), ("en", 3)]
    assert {r.lang for r in parts.where("doc_id IN (4, 5, 6, 7)").collect()} == {None} and parts.where("doc_id IN (4, 5, 6) AND n_words = 0 AND confidence = 0").count() == 3
    assert parts.where("doc_id = 9").count() == 2 and parts.where("doc_id = 8").head().n_words > 3000
    assert parts.where("confidence < 0 OR confidence > 1").isEmpty()
    assert {tuple(r) for r in L.disputed(parts).collect()} == {(1, "en"), (1, "de"), (3, "fr"), (8, "de")}
    assert L.segments(df.where("false"), model).collect() == []


def test_sentence_boundaries():
    text = "Court of Appeal Marru\nOrder 2020-09-16, 2 O 99/15\nA v. B Ltd\nHeadnote: One two (734.081,31 EUR).\n3 Mr. Smith put no. 5 on it at\n42 km and verseh-\nentlich left. Is it so? «Nein.» Yes!\nPage 2 of 3 | Land Tribunal Osttalda\n31 Ms Ro came\non foot.\n[7] End"
    s = L.sentences(pa.array([None, text, ""]))
    got = [" ".join(s.distinct[t] for t in s.index[a:b]) for a, b in zip(s.begin, s.end)]
    assert got == ["Court of Appeal Marru Order 2020-09-16, 2 O 99/15 A v. B Ltd", "Headnote: One two (734.081,31 EUR).", "3 Mr. Smith put no. 5 on it at 42 km and verseh- entlich left.", "Is it so?", "«Nein.»", "Yes!", "Page 2 of 3 | Land Tribunal Osttalda", "31 Ms Ro came on foot.", "[7] End"]
    assert s.whole.tolist() == [False, True, True, True, True, True, False, True, False]
    assert s.words[2] == 11 and set(s.text) == {1}


def test_without_labels(spark):
    m = L.train(spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string"))
    df = spark.createDataFrame([(1, HELD_OUT["en"], "en")], "doc_id bigint, text string, lang string")
    assert [r.lang for r in L.segments(df, m).collect()] == [None]


def test_titles_and_quotations_are_no_evidence():
    text = "Juzgado de distrito Logremir\nAuto 11.06.2014, HK 9408/22\nTotomir AG contra T.\n98 «Cassatie wordt niet toegelaten.»\nPor estas razones se declara que nunca llegó a recibir la carta que le envió V."
    s = L.sentences(pa.array([text]))
    got = [" ".join(s.distinct[t] for t in s.index[a:b]) for a, b in zip(s.begin, s.end)]
    assert got[1].startswith("98 «") and got[2].startswith("Por estas")
    assert s.whole.tolist() == [False, True, True] and s.words.tolist() == [10, 4, 16]
