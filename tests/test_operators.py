"""Small fixtures with hand-computed results."""

import gzip
import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmere.functions import text as X
from sparkmere.operators import assemble, dense, fusion, lexical, metrics, mining, overlap, pairs, synth
from sparkmere.sources import readers, writers
from sparkmere.streaming import resume


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_scalars(spark):
    df = spark.createDataFrame([("493371_1_1", "  Abc \t DEF "), ("abc", None), ("", "x")], "id string, title string")
    assert rows(df.select(X.article_id(F.col("id")).alias("a"), X.norm_title(F.col("title")).alias("t"))) == [("", "x"), ("493371", "abc def"), ("abc", "")]
    one = spark.range(1)
    got = one.select(X.json_list(F.lit('```json\n[{"i":0,"natural":"q?"}]\n```')), X.json_list(F.lit("no list")), X.is_question(F.lit("abc")), X.cache_key(F.lit("a/b--c/")), X.benchmark_article_id(F.lit("wiki_12_0"))).first()
    assert list(got) == ['[{"i":0,"natural":"q?"}]', None, False, "a_b_c", "12"]


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a b",), ("",), (None,)], "t string").select("t", X.shingles(X.tokens(F.col("t"))).alias("s"), F.size(X.shingle_hashes(X.tokens(F.col("t")))).alias("n"))
    assert {r.t: (r.s, r.n) for r in df.collect()} == {"a b c d e f g": (["a b c d e", "b c d e f", "c d e f g"], 3), "a b": (["a b"], 1), "": ([], 0), None: ([], 0)}


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_train.tsv").write_text("a\tb\na\n\nc\tt\tx\ty\n")
    with gzip.open(tmp_path / "sub" / "b.jsonl.gz", "wt") as f:
        f.write('{"doc_id":12,"text":""}\n{bad\n{"title":"no id"}\n{"_id":"c","heading":"last","body":"wins"}\n')
    files = readers.data_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[-1] for f in files] == ["a_train.tsv", "b.jsonl.gz"]
    assert readers.data_files(spark, str(tmp_path / "none")) == []
    assert readers.split_file(files, "TRAIN").endswith("a_train.tsv") and readers.split_file(files, "dev") is None
    assert rows(readers.read_corpus(spark, files), "doc_id") == [("12", "", ""), ("a", "", "b"), ("c", "last", "wins")]
    assert readers.inspect(spark, str(tmp_path)).count() == 4
    with pytest.raises(FileNotFoundError):
        readers.resolve_files(spark, [str(tmp_path / "*.none")])


def test_qrels(spark, tmp_path):
    (tmp_path / "q.txt").write_text("q1 0 d1 1\nq1 d2 0\nq1 d3\nq1 0 d4 -1\nq1 0 d5 x\nq1 0 d6 nan\none\n")
    got = readers.read_qrels(spark, [str(tmp_path / "q.txt")]).select("doc_id", "positive")
    assert rows(got) == [("d1", True), ("d2", False), ("d3", True), ("d4", False), ("d6", False)]


def test_other_readers(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id":null,"_id":"x","title":"","wiki_title":"T","text":"t"}\n{bad\n')
    assert rows(readers.read_benchmark(spark, [str(tmp_path / "b.jsonl")])) == [("None", "T", "t")]
    (tmp_path / "p.jsonl").write_text('{"id":"1","passage":"x"}\n{"id":"2","text":""}\n')
    assert rows(readers.read_ood_passages(spark, [str(tmp_path / "p.jsonl")])) == [("1", "x")]
    (tmp_path / "q.jsonl").write_text('{"query_id":"1","query":"x"}\n{"id":"2","text":"y","type":"factoid"}\n')
    assert rows(readers.read_ood_queries(spark, [str(tmp_path / "q.jsonl")])) == [("1", "x", "?"), ("2", "y", "factoid")]
    (tmp_path / "r.jsonl").write_text('{"query_id":"1","passage_id":"a","relevance":1}\n{"query_id":"1","passage_id":"a","relevance":2}\n{"query_id":"1","passage_id":"b"}\n{"query_id":"1","passage_id":"c","relevance":"x"}\n')
    assert rows(readers.read_ood_qrels(spark, [str(tmp_path / "r.jsonl")])) == [("1", "a")]
    (tmp_path / "x.txt").write_text(" 12 \n\n13\n")
    assert rows(readers.read_exclusions(spark, str(tmp_path / "x.txt"))) == [("12",), ("13",)]
    assert readers.read_exclusions(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "s.json").write_text('{"books": "book"}')
    assert rows(readers.read_stems(spark, str(tmp_path / "s.json"))) == [("books", "book")]
    (tmp_path / "t.tsv").write_text("q\tone\nq\ttwo\nz\t\n")
    assert rows(readers.read_topics(spark, [str(tmp_path / "t.tsv")])) == [("q", "two"), ("z", "")]
    (tmp_path / "u.JSONL").write_text('{"id":"1","text":"a","text":"b","title":true}\n{"id":2,"text":""}\n{"id":2,"text":null,"body":"x"}\n[1]\n')
    assert rows(readers.read_corpus(spark, [str(tmp_path / "u.JSONL")])) == [("1", "True", "b"), ("2", "", "x")]
    (tmp_path / "n.jsonl").write_text('{"query_id":"1","passage_id":"a","relevance":"NaN"}\n{"query_id":"1","passage_id":"b","relevance":0.5}\n')
    assert rows(readers.read_ood_qrels(spark, [str(tmp_path / "n.jsonl")])) == [("1", "b")]
    (tmp_path / "w.jsonl").write_text('{"query":"q","positive":"p","negatives":["n"],"extra":{"deep":[1,2]},"score":1.5}\n')
    whole = readers.read_pairs(spark, [str(tmp_path / "w.jsonl")])
    assert json.loads(whole.toJSON().first()) == {"query": "q", "positive": "p", "negatives": ["n"], "extra": {"deep": [1, 2]}, "score": 1.5}
    from sparkmere.sources import writers

    writers.write_jsonl(whole, str(tmp_path / "out"))
    writers.append_verbatim(spark, [str(tmp_path / "w.jsonl")], str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 2 and (tmp_path / "w.jsonl").read_text().strip() in lines
    (tmp_path / "e.jsonl").write_text('{"query_id":"1","query":"x","category":"natural","relevant_ids":["a","b","a"]}\n')
    q, rel = readers.read_query_file(spark, [str(tmp_path / "e.jsonl")])
    assert rows(q) == [("1", "x", "natural")] and rows(rel) == [("1", "a"), ("1", "b")]


def test_pairs_truncate_first(spark):
    corpus = spark.createDataFrame([("p", "T", "pos"), ("y", "", "neg y"), ("z", "", "neg z")], "doc_id string, title string, text string")
    topics = spark.createDataFrame([("q", "query")], "qid string, query string")
    qrels = spark.createDataFrame([("q", "p", True, 0), ("q", "gone", True, 1), ("q", "x", False, 2), ("q", "y", False, 3), ("q", "z", False, 4), ("r", "p", True, 5)], "qid string, doc_id string, positive boolean, ord long")
    got = pairs.build_pairs(corpus, topics, qrels, 2).collect()
    assert [(r.positive_id, r.negatives, r.negative_ids) for r in got] == [("p", ["neg y"], ["y"])]
    assert pairs.pair_stats(corpus, topics, qrels, 2).first().asDict() == {"queries": 2, "missing_query": 1, "missing_pos_doc": 1, "missing_neg_doc": 1, "pairs": 1, "neg_total": 1, "with_negatives": 1}


def test_overlap_counts_once(spark):
    bench = spark.createDataFrame([("wiki_7_0", "Title", "a b c d e f g")], "doc_id string, title string, text string")
    p = spark.createDataFrame([(1, "a b c d e f x", "7_1", " title "), (2, "a b c d e f x", "8_1", ""), (3, "other words", "7_2", ""), (4, "clean", "9_9", "")], "pair_id long, positive string, positive_id string, positive_title string")
    judged = overlap.with_reason(p, bench, 0.5, drop_by_article_id=True)
    assert rows(judged.select("pair_id", "reason")) == [(1, "title"), (2, "near_dup"), (3, "article_id"), (4, None)]
    r = overlap.report(judged, bench).first()
    assert r.pairs_in == r.pairs_kept + r.dropped_title + r.dropped_near_dup + r.dropped_article_id == 4 and r.benchmark_articles == 1
    assert rows(overlap.best_match(p, bench).select("pair_id", "jaccard")) == [(1, 0.5), (2, 0.5)]
    n = spark.createDataFrame([(1, ["a b c d e f g", "fine", "cut"], ["8_1", "9_1"]), (2, [], [])], "pair_id long, negatives array<string>, negative_ids array<string>")
    assert rows(overlap.clean_negatives(n, bench).select("pair_id", "negatives", "negative_ids", "n_stripped")) == [(1, ["fine"], ["9_1"], 1), (2, [], [], 0)]


DOCS = [("a_1", "алма ағаш алма"), ("a_2", "алма"), ("b_1", "ағаш көл тау көл"), ("c_1", "")]


def test_bm25_and_mining(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    idf = {r.term: round(r.idf, 6) for r in lexical.idf_table(docs).collect()}
    assert idf == {"алма": 0.693147, "ағаш": 0.693147, "көл": 1.203973, "тау": 1.203973}
    q = spark.createDataFrame([("q", "алма ағаш алма")], "qid string, query string")
    got = {r.doc_id: round(r.score, 6) for r in lexical.bm25_topk(q, docs).collect()}
    assert got == {"a_1": 1.418939, "a_2": 0.894383, "b_1": 0.478033}
    p = spark.createDataFrame([("1", "алма ағаш алма", "a_1")], "pair_id string, query string, positive_id string")
    for start, want in ((0, ["b_1"]), (2, ["b_1"]), (3, [])):
        assert [r.negative_id for r in mining.mine_negatives(p, docs, rank_start=start).collect()] == want


def test_fusion_and_metrics(spark):
    run = lambda ids: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ids)], "qid string, doc_id string, rank int")
    got = fusion.rrf(run(["d1", "d2", "d3"]), run(["d3", "d1", "d4"])).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in got] == [("d1", 0.032522475), ("d3", 0.032266458), ("d2", 0.016129032), ("d4", 0.015873016)]
    rel = spark.createDataFrame([("q", "r1"), ("q", "r2"), ("q", "r3"), ("none", "x")], "qid string, doc_id string")
    s = {r.qid: r for r in metrics.per_query(run(["x", "r1", "y", "r2"]), rel).collect()}
    assert (round(s["q"].ndcg, 6), s["q"].rr, round(s["q"].recall, 6)) == (0.498189, 0.5, 0.666667)
    assert (s["none"].ndcg, s["none"].rr, s["none"].recall) == (0, 0, 0)
    table = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.7)], "model string, value double")
    assert [r.model for r in metrics.rank_models(table, "value").collect()] == ["c", "b", "a"]


def test_dense(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<float>")
    p = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (0, [3.0, 0.0])], "doc_id long, vec array<float>")
    assert [(r.doc_id, round(r.score, 4)) for r in dense.dense_topk(q, p, 3).orderBy("rank").collect()] == [(0, 1.0), (2, 1.0), (1, 0.7071)]
    assert dense.dense_topk(q.where("false"), p, 3).count() == 0


def test_dense_holds_tiles_not_batches(spark):
    # A batch of 10,000 passages by all queries at once took 1.3 GB of a worker over 2.5 million vectors.
    rng, sizes = np.random.default_rng(1), []
    vec = np.round(rng.normal(size=(300, 4)), 1)
    vec[50:200] = vec[7]
    best = dense._Best(3, 5)
    unit = dense._unit(vec)
    for a in range(0, 300, 16):
        best.add(unit[[7, 20, 250]] @ unit[a : a + 16].T, pa.array(range(a, min(a + 16, 300))))
        sizes.append(best.size)
    best.settle()
    got = sorted(zip(*(np.concatenate([p[i] for p in best.parts]).tolist() for i in (0, 1)), pa.concat_arrays([p[2] for p in best.parts]).to_pylist(), strict=True), key=lambda r: (r[0], -r[1], r[2]))
    score = np.round(unit[[7, 20, 250]] @ unit.T, 9)
    want = [(q, score[q, i], i) for q in range(3) for i in np.lexsort((np.arange(300), -score[q]))[:5].tolist()]
    assert [r for q in range(3) for r in [x for x in got if x[0] == q][:5]] == want
    assert max(sizes) <= 2 * 8 * 3 * 5
    q = spark.createDataFrame([(i, vec[i].tolist()) for i in (7, 20, 250)], "qid long, vec array<double>")
    p = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vec)], "doc_id string, vec array<double>").repartition(3)
    rank = lambda k, i: np.lexsort((np.array(list(map(str, range(300)))), -score[k]))[i]
    assert rows(dense.dense_topk(q, p, 5).select("qid", "rank", "doc_id")) == [(x, i + 1, str(rank(k, i))) for k, x in enumerate((7, 20, 250)) for i in range(5)]


def test_judgements_by_class(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(30, None), (4, 1), (5, 0)], "id long, label int")
    queries, passages = labels.where("id % 4 = 0 or id = 5").select(F.col("id").alias("qid"), "label"), labels.select(F.col("id").alias("doc_id"), "label")
    run = spark.createDataFrame([(q, d, r + 1) for q in (0, 4, 5, 8) for r, d in enumerate((q, 3, 4, 5, 30))], "qid long, doc_id long, rank int")
    got = metrics.per_query(run, metrics.Classes(queries, passages))
    # The pairs themselves, as SQL makes them; repeated rows count.
    want = queries.join(passages, "label")
    n = dict(rows(want.groupBy("qid").count()))
    hits = dict(rows(run.where("rank <= 10").join(want, ["qid", "doc_id"], "left_semi").groupBy("qid").count()))
    assert {r.qid: r.recall for r in got.collect()} == {q: hits.get(q, 0) / n[q] for q in n}


def test_bootstrap_draws(spark):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.random(40), 2), np.round(rng.random(40), 2)
    of = [("a", "b", None, "ALL")[i % 4] for i in range(40)]
    frame = lambda v: spark.createDataFrame(list(zip(range(40), v.tolist(), strict=True)), "qid long, ndcg double")
    cats = spark.createDataFrame(list(zip(range(40), of, strict=True)), "qid long, category string")
    got = {r.scope: (r.n, round(r.delta, 9), r.p_value) for r in metrics.paired_bootstrap(frame(x), frame(y), cats, resamples=50).collect()}
    scopes = {}
    for i in range(40):
        for s in ("ALL", of[i] or "?"):
            scopes.setdefault(s, []).append(y[i] - x[i])
    want = {}
    for s, d in scopes.items():
        means = [round(sum(d[int(hashlib.md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % len(d)] for j in range(len(d))) / len(d), 12) for b in range(50)]
        delta = sum(d) / len(d)
        want[s] = len(d), round(delta, 9), sum(m <= 0 if delta >= 0 else m >= 0 for m in means) / 50
    assert got == want
    assert metrics.paired_bootstrap(frame(x).where("false"), frame(y), cats).count() == 0
    # Numbers drawn in parts are the same numbers.
    assert [*metrics.resample_numbers(3, 0, 5), *metrics.resample_numbers(3, 5, 9)] == [*metrics.resample_numbers(3, 0, 9)]


def test_assembly(spark):
    t = spark.createDataFrame([("q", "p", ["", "u", "v"]), ("q2", "p2", []), ("", "p3", ["u"])], "query string, positive string, negatives array<string>")
    assert rows(assemble.triplets(t, 1)) == [("q", "p", "u")] and rows(assemble.plain_pairs(t)) == [("q2", "p2")]
    one = spark.range(1).select(assemble.take_then_filter(F.array(F.lit(""), F.lit("u")), 1).alias("a"), assemble.filter_then_take(F.array(F.lit(""), F.lit("u")), 1).alias("b")).first()
    assert (one.a, one.b) == ([], ["u"])


def test_synthesis(spark, tmp_path):
    corpus = spark.createDataFrame([(f"{i}_0", "t", f"text number {i} " * 20) for i in range(7)], "doc_id string, title string, text string")
    none = spark.createDataFrame([], "passage_id string")
    pool = synth.passage_pool(corpus, spark.createDataFrame([("3",)], "article_id string"), none, 10, 50)
    b = synth.batches(pool, 5)
    replies = synth.ask(synth.prompts(b), synth.offline_provider)
    got = synth.questions(synth.parse_replies(replies), b)
    assert got.count() == 18 and got.where("passage_id = '3_0'").count() == 0
    bad = spark.createDataFrame([(0, '[{"i":"0","natural":"a question"}]')], "batch_id long, reply string")
    assert synth.parse_replies(bad).count() == 0
    out, src, cp = str(tmp_path / "out"), str(tmp_path / "src"), str(tmp_path / "cp")
    writers.write_jsonl(got.select("passage_id", "query"), src)
    spark.range(1).select(F.lit("0_0").alias("passage_id")).write.json(out)
    stream = spark.readStream.schema("passage_id string, query string").json(src)
    resume.resumable_sink(stream, out, cp).awaitTermination()
    assert spark.read.json(out).where("passage_id = '0_0'").count() == 1 and spark.read.json(out).count() == 16


def test_writers(spark, tmp_path):
    report = spark.createDataFrame([("ALL", 0.5, 0.6, 0.1, 0.01)], "scope string, a double, b double, delta double, p_value double")
    writers.write_report(report, str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r").glob("part-*")).read_text())["delta"] == 0.1
    assert writers.console_table(report).first().line.rstrip().endswith("*")


def test_stems(spark):
    docs = spark.createDataFrame([("1", "books 12 x running odd")], "doc_id string, text string")

    def service(words):
        if len(words) > 1:
            raise RuntimeError("too many")
        return {"books": "book", "running": ""}

    got = lexical.extend_stems(docs, spark.createDataFrame([("odd", "odd")], "word string, stem string"), service)
    assert rows(got) == [("books", "book"), ("odd", "odd"), ("running", "running")]
