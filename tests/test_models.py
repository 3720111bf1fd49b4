"""Topic models find planted topics; streams equal their batch form; readers read what was written."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators.ctfidf import decayed
from strandloom.operators.topics import corex, guided, lda, tree
from strandloom.schema import checked
from strandloom.sources import readers as R
from strandloom.sources import sinks as S
from strandloom.streaming.bow import stream_decayed_counts, stream_term_counts


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(120):
        t = c % 3
        for g in range(30):
            v = rng.poisson(4 if g // 10 == t else 0.15)
            if v:
                rows.append((f"c{c:03d}", f"g{g:02d}", float(v)))
    return spark.createDataFrame(rows, "cell_id string, gene string, value double").cache()


def agreement(cell_topic):
    got = {}
    for r in cell_topic.collect():
        got.setdefault(r.cell_id, {})[r.topic_id] = r.weight
    groups = [[max(got[f"c{c:03d}"], key=got[f"c{c:03d}"].get) for c in range(120) if c % 3 == t and f"c{c:03d}" in got] for t in range(3)]
    best = [max(set(g), key=g.count) for g in groups]
    return len(set(best)), np.mean([x == b for g, b in zip(groups, best) for x in g])


def test_lda_finds_topics(spark, planted):
    fit = lda.fit_lda(planted, 3, 30, seed=2)
    kinds, share = agreement(fit.cell_topic)
    assert kinds == 3 and share > 0.9
    assert fit.gene_topic.groupBy("topic_id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-6").isEmpty()


def test_lda_uses_every_cell(spark):
    """Each cell has a gene of its own, which weighs next to nothing if the cell is never drawn."""
    df = spark.createDataFrame([(f"c{c:03d}", f"g{c:03d}", 500.0) for c in range(150)], "cell_id string, gene string, value double")
    w = lda.fit_lda(df, 3, 30).about["model"].topicsMatrix().toArray().sum(axis=1)
    assert w.min() > 0.2 * w.mean()


def test_lda_counts_every_cell_once_a_pass(spark, planted):
    """Cells that are alike weigh alike, and the fit doesn't depend on where cells lie."""
    df = spark.createDataFrame([(f"c{c:03d}", f"g{c:03d}", 500.0) for c in range(150)], "cell_id string, gene string, value double")
    w = lda.fit_lda(df, 3, 3).about["model"].topicsMatrix().toArray().sum(axis=1)
    assert w.max() < 1.02 * w.min()
    one, many = (lda.fit_lda(planted.repartition(n), 3, 5) for n in (1, 5))
    assert np.allclose(one.about["model"].topicsMatrix().toArray(), many.about["model"].topicsMatrix().toArray(), rtol=1e-6)
    assert one.about["perplexity"] == pytest.approx(many.about["perplexity"]) and 0 < one.about["perplexity"] < np.log(30)


def test_lda_steps_equal_plain_loops(monkeypatch):
    """Cells settled together, in blocks and dropping out one by one, are those settled alone; their weights sum to tokens and priors."""
    import math

    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 12, 40)
    genes = np.concatenate([np.sort(rng.choice(20, n, False)) for n in sizes])
    values, beta = rng.integers(1, 9, sizes.sum()), rng.dirichlet(np.ones(20), 4)
    monkeypatch.setattr(lda, "CELLS", 7)
    got, ends = lda.settle(genes, sizes, values, beta, 0.25), np.r_[0, np.cumsum(sizes)]
    for c in range(40):
        g, v = genes[ends[c] : ends[c + 1]], values[ends[c] : ends[c + 1]]
        gamma, moved = np.full(4, 0.25 + v.sum() / 4), 1.0
        while moved >= lda.SETTLED:
            e = np.exp(lda.digamma(gamma))
            new = 0.25 + e * (beta[:, g] * (v / (e @ beta[:, g]))).sum(axis=1)
            gamma, moved = new, np.abs(new - gamma).mean()
        assert np.allclose(got[:, c], gamma) and gamma.sum() == pytest.approx(v.sum() + 1)
    x = np.array([1e-3, 0.2, 1.0, 3.5, 1e4])
    assert np.allclose(lda.digamma(x), [(math.lgamma(a * (1 + 1e-5)) - math.lgamma(a * (1 - 1e-5))) / (2e-5 * a) for a in x], rtol=1e-5)


def test_guided_lda_follows_seeds_and_keeps_tokens(spark, planted):
    seeds = {"g00": 2, "g01": 2, "g10": 0, "g11": 0, "g20": 1, "g21": 1}
    fit = guided.fit_guided(planted, 3, seeds, confidence=0.9, n_iter=8)
    assert fit.about["tokens"] == planted.agg(F.sum(F.floor("value"))).head()[0]
    assert fit.about["log_likelihood"][-1] > fit.about["log_likelihood"][0]
    kinds, share = agreement(fit.cell_topic)
    assert kinds == 3 and share > 0.9
    top = {r.gene: r.topic_id for r in fit.gene_topic.groupBy("gene").agg(F.max_by("topic_id", "weight").alias("topic_id")).collect()}
    assert [top[g] for g in ("g00", "g05", "g15", "g25")] == [2, 2, 0, 1]
    assert agreement(guided.infer_guided(fit, planted))[1] > 0.9


def test_corex_finds_topics_and_layers(spark, planted):
    fit = corex.fit_corex(planted, 3, {"g00": 0, "g10": 1, "g20": 2}, n_iter=12)
    assert fit.about["tc"][-1] > fit.about["tc"][0]
    kinds, share = agreement(fit.cell_topic)
    assert kinds == 3 and share > 0.9
    layers, edges = corex.hierarchy(fit, [2], n_iter=4)
    assert edges.count() > 0 and set(edges.columns) == {"parent_layer", "parent", "child_layer", "child", "weight"}


def test_topic_tree(spark):
    gt = spark.createDataFrame([("a", 0, 0.9), ("b", 0, 0.1), ("a", 1, 0.8), ("b", 1, 0.2), ("z", 2, 1.0)], "gene string, topic_id int, weight double")
    out = tree.topic_tree(gt).orderBy("parent").collect()
    assert [(r.left, r.right) for r in out] == [(0, 1), (2, 3)] and out[0].name.startswith("a") and list(out[1].topics) == [0, 1, 2]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0)] * 10 + [("b", 0)], "t string, batch bigint").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("t string, batch bigint").parquet(src)

    def drain(df, mode, name):
        # a sink that can be started again from its checkpoint, which the memory sink can't be in update mode
        out, how = str(tmp_path / f"{name}_out"), "overwrite" if mode == "complete" else "append"
        q = df.writeStream.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode(how).parquet(out)).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(out).collect()

    assert {(r.term, r.n) for r in drain(stream_term_counts(stream, "t"), "complete", "vocab")} == {("a", 10), ("b", 1)}
    drain(stream_decayed_counts(stream, "t", "batch", 0.1), "update", "fade")
    spark.createDataFrame([("a", 2)] * 5 + [(None, 2)], "t string, batch bigint").coalesce(1).write.mode("append").parquet(src)
    out = drain(stream_decayed_counts(stream, "t", "batch", 0.1), "update", "fade")
    last = {r.term: (r.value, r.last_batch) for r in sorted(out, key=lambda r: r.last_batch)}
    every = spark.read.parquet(src).where("t IS NOT NULL").groupBy("t", "batch").agg(F.count("*").alias("n"))
    want = {r.t: r.value for r in decayed(every, "batch", "t", 0.1, 2).collect()}
    assert last["a"][0] == pytest.approx(want["a"]) == pytest.approx(13.1)
    pruned = drain(stream_decayed_counts(stream, "t", "batch", 0.1, min_total=5.0), "update", "pruned")
    assert {(r.term, round(r.value, 6)) for r in pruned} == {("a", 13.1), ("b", 0.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "dense.tsv").write_text("c1\tc2\ngA\t1\t0\ngB\t0\t2.5\n")
    want = {("c1", "gA", 1.0), ("c2", "gB", 2.5)}
    assert {tuple(r) for r in R.read_counts(spark, str(tmp_path / "dense.tsv")).collect()} == want
    (tmp_path / "corner.txt").write_text("id,c1,c2\ngA,1,0\ngB,0,2.5\n")
    assert {tuple(r) for r in R.read_count_text(spark, str(tmp_path / "corner.txt"), "comma").collect()} == want
    (tmp_path / "anno.tsv").write_text("c1\tT\nc2\tB\nc1\tNK\n")
    assert {tuple(r) for r in R.read_annotation(spark, str(tmp_path / "anno.tsv")).collect()} == {("c1", "NK"), ("c2", "B")}
    with gzip.open(tmp_path / "f.tsv.gz", "wt") as f:
        f.write("# x\nchr1\t5\t9\tbc\t3\t+\nchr2\t1\t2\tbd\n")
    assert {tuple(r) for r in R.read_fragments(spark, str(tmp_path / "f.tsv.gz"), 2).collect()} == {("chr1", 5, 9, "bc", 3.0, "+"), ("chr2", 1, 2, "bd", 1.0, None)}
    (tmp_path / "list.tsv").write_text("n\tgene_name\n1\tb\n2\ta\n3\t\n4\tc\n")
    assert {tuple(r) for r in R.read_gene_list(spark, str(tmp_path / "list.tsv")).collect()} == {(0, "b"), (1, "a"), (2, "c")}
    (tmp_path / "bad.tsv").write_text("chr1\t5\t9\n")
    with pytest.raises(ValueError):
        R.read_fragments(spark, str(tmp_path / "bad.tsv"))
    folder = tmp_path / "pred" / "x"
    folder.mkdir(parents=True)
    (folder / "S1_a_predicted_filtered_peaks.csv").write_text('"X","p1","p2"\n"B",1,2\n')
    (folder / "S2_predicted_filtered_peaks.csv").write_text('"X","p3"\n"T",4\n')
    assert {tuple(r) for r in R.read_predicted_peaks(spark, str(tmp_path / "pred")).collect()} == {("S1", "B", "p1", 1.0), ("S1", "B", "p2", 2.0), ("S2", "T", "p3", 4.0)}


def test_transfer_objects_and_matrices(spark, tmp_path):
    gt = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "gene string, topic_id int, weight double")
    ct = spark.createDataFrame([("c", 0, 1.0)], "cell_id string, topic_id int, weight double")
    tt = spark.createDataFrame([(0, "T", 1.0)], "topic_id int, main_cell_type string, weight double")
    S.write_transfer(str(tmp_path / "m"), gt, ct, tt, "lda")
    back = S.read_transfer(spark, str(tmp_path / "m"))
    meta = back["meta"].head()
    assert (meta.n_genes, meta.n_topics, meta.n_cells, meta.n_celltypes, meta.backend) == (2, 2, 1, 1, "lda")
    S.write_dense(gt, str(tmp_path / "d"), "gene", "topic_id", "weight")
    assert {tuple(r) for r in R.read_matrix(spark, str(tmp_path / "d"), "gene", "topic_id").collect()} == {("a", "0", 1.0), ("b", "1", 1.0)}
    with pytest.raises(ValueError, match="weight"):
        checked(gt.drop("weight"), "gene_topic")
    lines = [r.value for r in S.enhancer_bed(spark.createDataFrame([("c", 1, 2, "r", 1)], "chr string, start int, end int, region_id string, rank int"), "x").collect()]
    assert lines[0].startswith("track") and lines[1] == "c\t1\t2\tr\t1"


def test_enhancer_lines(spark):
    rows = spark.createDataFrame([("c", 5, 9, "r2", 2, False), ("c", 1, 2, "r1", 1, True)], "chr string, start int, end int, region_id string, rank int, is_super boolean")
    lines = [r.value for r in S.enhancer_bed(rows, "a b").collect()]
    assert lines[0].startswith('track name="a_b" description="a b"') and lines[1:3] == ["c\t1\t2\tr1\t1", "c\t5\t9\tr2\t2"]
    assert lines[3].startswith('track name="Super_a_b"') and lines[4:] == ["c\t1\t2\tr1\t1"]
    assert [r.value for r in S.enhancer_gateway(rows).collect()] == ["c\t1\t2\tr1\t1\t.", "c\t5\t9\tr2\t2\t."]
    assert S.enhancer_bed(rows.where("false"), "a").count() == 0 and S.enhancer_bed(rows.where("NOT is_super"), "a").count() == 2


def test_counts_from_files_clamp_negatives_and_may_be_empty(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("g\tc1\tc2\ngA\t-3\t2\ngB\t-1\tx\n")
    assert {tuple(r) for r in R.read_counts(spark, str(tmp_path / "n.tsv")).collect()} == {("c2", "gA", 2.0)}
    (tmp_path / "e.tsv").write_text("")
    assert R.read_counts(spark, str(tmp_path / "e.tsv")).count() == 0
    spark.createDataFrame([(1, "g", "2.5", 0)], "cell_id int, gene string, value string, other int").write.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in R.read_counts(spark, str(tmp_path / "p")).collect()] == [("1", "g", 2.5)]
