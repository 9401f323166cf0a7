"""The command line's steps on small files, and the clients with senders of their own."""

import json
import urllib.error

import pytest

from sparkmere import cli
from sparkmere.operators import clients


def lines(spark, path):
    return [json.loads(r.value) for r in spark.read.text(str(path)).collect()]


@pytest.fixture
def files(tmp_path):
    corpus = [{"id": f"{i}_0", "title": f"t{i}", "text": f"passage {i} " + " ".join(f"w{i}x{j}" for j in range(60)) + " common words"} for i in range(12)]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, corpus)))
    pairs = [{"query": f"common w{i}x3", "positive": corpus[i]["text"], "positive_id": f"{i}_0", "positive_title": f"t{i}", "negatives": [corpus[i + 1]["text"]], "negative_ids": [f"{i + 1}_0"], "more": {"deep": i}} for i in range(4)]
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, pairs)))
    (tmp_path / "bench.jsonl").write_text(json.dumps({"doc_id": "item-1", "text": corpus[1]["text"]}))
    return tmp_path


def test_decontaminate_keeps_whole_records(spark, files):
    for probe in ([], ["--probe", "48"]):
        cli.main(["decontaminate", "--pairs", str(files / "pairs.jsonl"), "--benchmark-corpus", str(files / "bench.jsonl"), "--benchmark-id-regex", r"item-(\d+)", "--out", str(files / "out"), "--report", str(files / "report"), *probe])
        out = {r["positive_id"]: r for r in lines(spark, files / "out")}
        assert set(out) == {"0_0", "2_0", "3_0"} and out["2_0"]["more"] == {"deep": 2} and out["0_0"]["negatives"] == []
        report = json.loads("".join(r.value for r in spark.read.text(str(files / "report")).collect()))
        assert report["dropped_near_dup"] == 1 and report["article_id_overlap"] == 1 and report["negatives_stripped"] == 1


def test_mine_and_assemble(spark, files):
    cli.main(["mine", "--pairs", str(files / "pairs.jsonl"), "--corpus", str(files / "corpus.jsonl"), "--ids-only", "--out", str(files / "mined")])
    mined = lines(spark, files / "mined")
    assert len(mined) == 4 and all(len(r["negative_ids"]) == 4 and r["positive_id"] not in r["negative_ids"] for r in mined)
    gold = '{"query":"g",  "positive":"p", "odd":[1]}'
    (files / "gold.jsonl").write_text(gold + "\n\n")
    cli.main(["assemble", "--ids", str(files / "mined"), "--corpus", str(files / "corpus.jsonl"), "--gold", str(files / "gold.jsonl"), "--out", str(files / "train")])
    got = [r.value for r in spark.read.text(str(files / "train")).collect()]
    assert len(got) == 5 and gold in got


def test_synthesize(spark, files):
    cli.main(["synthesize", "--corpus", str(files / "corpus.jsonl"), "--provider", "offline", "--out", str(files / "synth")])
    assert len(lines(spark, files / "synth")) == 36
    cli.main(["synthesize", "--corpus", str(files / "corpus.jsonl"), "--out", str(files / "synth")])
    assert len(lines(spark, files / "synth")) == 36


def error(code):
    return urllib.error.HTTPError("u", code, "", {}, None)


def test_attempts():
    waits, codes = [], [429, 500, 503]

    def send():
        if codes:
            raise error(codes.pop(0))
        return "done"

    assert clients.with_attempts(send, 5, waits.append) == "done" and waits == [4, 4, 8]
    with pytest.raises(clients.Refused):
        clients.with_attempts(lambda: (_ for _ in ()).throw(error(403)), 5, waits.append)
    with pytest.raises(urllib.error.HTTPError):
        clients.with_attempts(lambda: (_ for _ in ()).throw(error(404)), 5, waits.append)


def test_stemmer_halves_and_keeps_its_budget():
    def send(words):
        if "bad" in words:
            raise OSError
        return [{"word": w, "stem": w[:2]} for w in words]

    saved = []
    c = clients.Stemmer(send, batch=4, attempts=2, sleep=lambda s: None)
    assert c.stems(["abc", "bad", "cde", "def", "efg"], lambda d: saved.append(len(d))) == {"abc": "ab", "bad": "bad", "cde": "cd", "def": "de", "efg": "ef"}
    assert c.failed == ["bad"] and saved == [5]
    with pytest.raises(clients.BudgetSpent):
        clients.Stemmer(send, batch=1, budget=2, sleep=lambda s: None).stems(["a", "b", "c"])
