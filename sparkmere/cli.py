"""Command line: the dataset pipeline's steps on files.

python -m sparkmere.cli prepare|decontaminate|synthesize|mine|assemble|examples|evaluate ... --help
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.functions.text import BENCHMARK_ID
from sparkmere.operators import assemble, clients, dense, fusion, lexical, metrics, mining, overlap, pairs, synth
from sparkmere.sources import readers, writers


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("pair_id", F.monotonically_increasing_id().cast("string"))


def prepare(s: SparkSession, a: argparse.Namespace) -> None:
    if a.inspect:
        readers.inspect(s, a.root).show(100, False)
        return
    corpus = readers.read_corpus(s, readers.resolve_files(s, a.corpus_file) if a.corpus_file else readers.data_files(s, f"{a.root}/corpus"))
    out = None
    for split in a.splits:
        files = [readers.split_file(readers.data_files(s, f"{a.root}/{kind}"), split) for kind in ("topics", "qrels")]
        if None in files:
            print(f"{split}: no topics or no judgements, passed over")
            continue
        topics, qrels = readers.read_topics(s, files[:1]), readers.read_qrels(s, files[1:])
        pairs.pair_stats(corpus, topics, qrels, a.max_neg).show()
        part = pairs.build_pairs(corpus, topics, qrels, a.max_neg, split).drop("ord")
        out = part if out is None else out.unionByName(part)
    if out is None or not out.limit(1).count():
        raise SystemExit("no pairs")
    writers.write_jsonl(out, a.out)


def decontaminate(s: SparkSession, a: argparse.Namespace) -> None:
    p, bench = _keyed(readers.read_pairs(s, a.pairs)), readers.read_benchmark(s, a.benchmark_corpus)
    p = p.persist()
    judged = overlap.with_reason(p, bench, a.jaccard, a.shingle_size, a.drop_by_article_id, pattern=a.benchmark_id_regex, probe=a.probe).persist()
    kept, stripped = judged.where("reason IS NULL").drop("reason", "article_hit"), 0
    if not a.skip_neg_check:
        kept = overlap.clean_negatives(kept, bench, a.jaccard, a.shingle_size, a.drop_by_article_id, pattern=a.benchmark_id_regex, probe=a.probe).persist()
        stripped = kept.agg(F.coalesce(F.sum("n_stripped"), F.lit(0))).first()[0]
        kept = kept.drop("n_stripped")
    writers.write_jsonl(kept.drop("pair_id"), a.out)
    writers.write_report(overlap.report(judged, bench, stripped, a.benchmark_id_regex, shingle_size=a.shingle_size, jaccard=a.jaccard, drop_by_article_id=a.drop_by_article_id), a.report)


def synthesize(s: SparkSession, a: argparse.Namespace) -> None:
    corpus, done = readers.read_corpus(s, readers.resolve_files(s, a.corpus)), readers.read_done_ids(s, a.out)
    rows = synth.batches(synth.passage_pool(corpus, readers.read_exclusions(s, a.exclude_article_ids), done, a.n_passages, a.min_chars, a.seed), a.batch, a.seed).persist()
    replies = synth.ask(synth.prompts(rows), clients.PROVIDERS[a.provider](a.model, a.sleep))
    writers.write_jsonl(synth.questions(synth.parse_replies(replies), rows), a.out, "append")


def _stems(s: SparkSession, a: argparse.Namespace, texts: DataFrame) -> DataFrame | None:
    """The stem dictionary, with the words that it lacks asked of the service, if one is given, and saved as answers come.

    The words of a pool are few enough for one client, which keeps to the service's rate and budget.
    """
    have = readers.read_stems(s, a.stem_cache) if a.stem_cache and os.path.exists(a.stem_cache) else s.createDataFrame([], "word string, stem string")
    if a.stemmer:
        words = [r.word for r in lexical.missing_words(texts, have).toLocalIterator()]
        known = {r.word: r.stem for r in have.toLocalIterator()}

        def save(new: dict[str, str]) -> None:
            if a.stem_cache:
                with open(a.stem_cache, "w", encoding="utf-8") as f:
                    json.dump(known | new, f, ensure_ascii=False)

        client = clients.Stemmer(clients.stem_service(a.stemmer, os.environ.get("STEMMER_KEY", "")), budget=a.max_stem_requests)
        return s.createDataFrame(list((known | client.stems(words, save)).items()), "word string, stem string")
    return have if a.stem_cache else None


def mine(s: SparkSession, a: argparse.Namespace) -> None:
    p = mining.with_positive_id(_keyed(readers.read_pairs(s, a.pairs))).persist()
    corpus = readers.read_corpus(s, readers.resolve_files(s, a.corpus))
    pool = mining.candidate_pool(corpus, p, readers.read_exclusions(s, a.exclude_article_ids), a.pool_sample, a.seed).persist()
    stems = _stems(s, a, pool.select("text").unionByName(p.select(F.col("query").alias("text"))))
    got = mining.mine_negatives(p, pool, a.n_neg, a.neg_rank_start, a.top_k, stems=stems)
    mined = mining.with_negatives(p, got, pool).drop("pair_id")
    writers.write_jsonl(writers.ids_only(mined) if a.ids_only else mined, a.out)


def assemble_(s: SparkSession, a: argparse.Namespace) -> None:
    ids, corpus = _keyed(readers.read_pairs(s, a.ids)).persist(), readers.read_corpus(s, readers.resolve_files(s, a.corpus))
    made = assemble.expand_ids(ids, corpus).drop("pair_id", "miss_neg")
    writers.write_jsonl(made, a.out)
    if a.gold:
        writers.append_verbatim(s, a.gold, a.out)


def examples(s: SparkSession, a: argparse.Namespace) -> None:
    train = readers.read_pairs(s, a.data)
    assemble.train_stats(train, a.max_neg_per_pair, a.batch_size, a.epochs, a.warmup_ratio).show()
    writers.write_jsonl(assemble.examples(train, a.max_neg_per_pair).select("anchor", "positive", "negative"), a.out)


def evaluate(s: SparkSession, a: argparse.Namespace) -> None:
    """Vectors are Parquet: queries (qid, vec) and passages (doc_id, vec) of each system."""
    if a.qrels:
        queries, qrels = readers.read_ood_queries(s, a.queries), readers.read_ood_qrels(s, a.qrels)
    else:
        queries, qrels = readers.read_query_file(s, a.queries)
    vec = lambda name: dense.dense_topk(s.read.parquet(f"{name}/queries"), s.read.parquet(f"{name}/passages"), 100).persist()
    systems = {"base": vec(a.base), "finetuned": vec(a.finetuned)}
    if a.vs_model:
        systems["other"] = vec(a.vs_model)
    if a.hybrid:
        passages = readers.read_ood_passages(s, a.corpus)
        stems = readers.read_stems(s, a.bm25_stemmer) if a.bm25_stemmer else None
        systems["bm25"] = lexical.bm25_topk(queries, passages, 100, stems=stems).persist()
        systems["hybrid"] = fusion.rrf(systems["finetuned"], systems["bm25"], k=a.rrf_k)
    table = metrics.eval_table(systems, qrels, queries, a.top_k)
    against = lambda name: metrics.paired_bootstrap(metrics.per_query(systems[name], qrels, a.top_k), metrics.per_query(systems["finetuned"], qrels, a.top_k), queries, resamples=a.n_resamples)
    rows = table.join(against("base"), "scope")
    if a.vs_model:
        rows = rows.join(against("other").select("scope", F.col("delta").alias("delta_other"), F.col("p_value").alias("p_value_other")), "scope")
    rows = rows.orderBy("scope")
    writers.console_table(rows.select("scope", *systems, "delta", "p_value")).show(100, False)
    writers.write_jsonl(rows, a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, how in options:
            p.add_argument(flag, **how)

    many, need, yes = {"nargs": "+", "required": True}, {"required": True}, {"action": "store_true"}
    num = lambda x: {"type": type(x), "default": x}
    command("prepare", prepare, ("--root", need), ("--inspect", yes), ("--splits", {"nargs": "+", "default": ["train"]}), ("--corpus-file", {"nargs": "+"}), ("--max-neg", num(8)), ("--out", {"default": "pairs"}))
    command("decontaminate", decontaminate, ("--pairs", many), ("--benchmark-corpus", many), ("--out", need), ("--report", need), ("--shingle-size", num(5)), ("--jaccard", num(0.5)), ("--drop-by-article-id", yes), ("--skip-neg-check", yes), ("--benchmark-id-regex", {"default": BENCHMARK_ID}), ("--probe", {"type": int, "help": "only pairs that share one of so many least shingles; default: all"}))
    command("synthesize", synthesize, ("--corpus", many), ("--n-passages", num(14_000)), ("--batch", num(5)), ("--min-chars", num(200)), ("--exclude-article-ids", {}), ("--provider", {"choices": sorted(clients.PROVIDERS), "default": "offline"}), ("--model", {"default": ""}), ("--sleep", num(0.0)), ("--out", need), ("--seed", num(13)))
    command("mine", mine, ("--pairs", many), ("--corpus", many), ("--exclude-article-ids", {}), ("--stem-cache", {}), ("--stemmer", {}), ("--max-stem-requests", num(0)), ("--pool-sample", num(80_000)), ("--n-neg", num(4)), ("--neg-rank-start", num(2)), ("--top-k", num(50)), ("--ids-only", yes), ("--out", need), ("--seed", num(13)))
    command("assemble", assemble_, ("--ids", many), ("--corpus", many), ("--gold", {"nargs": "+"}), ("--out", need))
    command("examples", examples, ("--data", many), ("--max-neg-per-pair", num(4)), ("--batch-size", num(128)), ("--epochs", num(2)), ("--warmup-ratio", num(0.1)), ("--out", need))
    command("evaluate", evaluate, ("--queries", many), ("--qrels", {"nargs": "+"}), ("--corpus", {"nargs": "+"}), ("--base", need), ("--finetuned", need), ("--vs-model", {}), ("--hybrid", yes), ("--bm25-stemmer", {}), ("--rrf-k", num(60)), ("--top-k", num(10)), ("--n-resamples", num(10_000)), ("--out", need))
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName(f"sparkmere-{a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
