import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import SECRETS, chat
from promptledger.operators import normalise, reports
from promptledger.operators.pricing import ThresholdPolicy
from promptledger.plans.chain import batch_chain
from promptledger.session import cut_lineage
from promptledger.sources import requests as sources

KEY = SECRETS["aws_access_key_id"]


def folder(tmp_path, **files):
    for name, content in files.items():
        path = tmp_path / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.with_suffix(".json").write_text(content, encoding="utf-8")
    return str(tmp_path)


def scan(files, chain=None):
    chain = chain or batch_chain(pii_scan=True)
    return chain, chain.decide(normalise.normalise_files(files))


def text_of(spark, files):
    chain, out = scan(files)
    lines = reports.report_lines(cut_lineage(out), chain.names)
    return [r["line"].replace("\\", "/") for r in lines.orderBy("position", "file", "line_no").collect()]


def test_files_of_a_folder(spark, tmp_path):
    path = folder(tmp_path, b=chat("gpt-4o", KEY), a=chat("claude-3", "fine"), sub__c="[]", z=chat("m", "a@b.com"))
    (tmp_path / "note.txt").write_text("not a prompt")
    files = sources.read_prompt_files(spark, path)
    assert files.count() == 4
    assert text_of(spark, files) == [
        f"{path}/a.json: PASS",
        f"{path}/b.json: FAIL (secret_scan: secret_exposure_detected)",
        "    - AWS Access Key ID severity=high preview=AKIA***" + KEY[-2:],
        f"{path}/z.json: FAIL (pii_scan: pii_exposure_detected)",
        "    - EMAIL_ADDRESS severity=high preview=a@b.***om",
        "summary: scanned=3 allowed=1 rejected=2",
    ]


def test_listed_files_keep_their_order(spark, tmp_path):
    path = folder(tmp_path, a=chat("m", "x"), b=chat("m", "y"), c=chat("m", "z"))
    order = [f"{path}/{n}.json" for n in "cab"]
    lines = text_of(spark, sources.read_prompt_list(spark, order))
    assert lines[:3] == [f"{p}: PASS" for p in order]
    assert sources.read_prompt_list(spark, []).count() == 0


@pytest.mark.parametrize("pattern", ["nothing-here", "*.json", "deep/*/x*.json"])
def test_nothing_found_is_a_clean_batch(spark, tmp_path, pattern):
    files = sources.read_prompt_files(spark, f"{tmp_path}/{pattern}")
    _, out = scan(files)
    assert reports.gate(out).first()["gate"] == 0
    assert tuple(reports.batch_summary(out).first()) == (0, 0, 0)


@pytest.mark.parametrize(
    "contents, gate",
    [
        ([chat("m", "fine")], 0), ([chat("m", "fine"), chat("m", KEY)], 1), ([chat("m", "fine"), "[1]"], 2),
        (["{"], 2), ([chat("m", KEY), '{"messages": []}'], 2),
    ],
)
def test_gate(spark, tmp_path, contents, gate):
    path = folder(tmp_path, **{f"f{i}": c for i, c in enumerate(contents)})
    listed = [f"{path}/f{i}.json" for i in range(len(contents))]
    for files in (sources.read_prompt_list(spark, listed), sources.read_prompt_files(spark, path)):
        if all(contents):
            assert reports.gate(scan(files)[1]).first()["gate"] == gate
    missing = sources.read_prompt_list(spark, [*listed, f"{path}/gone.json"])
    assert reports.gate(scan(missing)[1]).first()["gate"] == 2


def test_empty_and_missing_files_are_input_errors(spark, tmp_path):
    path = folder(tmp_path, a=chat("m", "fine"), b="")
    for listed in (["a", "b"], ["a", "gone"], ["gone"]):
        files = sources.read_prompt_list(spark, [f"{path}/{n}.json" for n in listed])
        assert files.count() == len(listed)
        assert reports.gate(scan(files)[1]).first()["gate"] == 2


def test_provider_comes_from_the_body(spark, tmp_path):
    path = folder(tmp_path, a=chat("gpt-4o", "x", system="be kind"), b=chat("gpt-4o", "x"))
    rows = normalise.normalise_files(sources.read_prompt_files(spark, path)).orderBy("label").collect()
    assert [(r["provider"], r["content"]) for r in rows] == [("anthropic", "be kind\nx"), ("openai", "x")]


def test_file_results_and_decision_documents(spark, tmp_path, counter):
    path = folder(tmp_path, a=chat("gpt-4o", "some words here"), b=chat("gpt-4o", f"é {KEY}"))
    chain = batch_chain(tokens=True, counter=counter, policy=ThresholdPolicy(2))
    _, out = scan(sources.read_prompt_files(spark, path), chain)
    first, second = reports.file_results(out, chain.names).orderBy("file").collect()
    assert first["rejecting_middleware"] == "tokenomics" and second["rejecting_middleware"] == "secret_scan"
    notes = json.loads(first["annotations"])
    assert list(notes) == ["secret_scan", "tokenomics"]
    assert notes["secret_scan"] == {"finding_count": 0}
    assert notes["tokenomics"]["violations"] == ["token_limit"]
    assert isinstance(notes["tokenomics"]["estimated_cost_usd"], str)
    assert json.loads(second["annotations"]) == {
        "secret_scan": {
            "finding_count": 1,
            "findings": [
                {
                    "kind": "aws_access_key_id", "label": "AWS Access Key ID", "severity": "high",
                    "span": [2, 22], "preview": "AKIA***" + KEY[-2:],
                }
            ],
        }
    }
    documents = out.select(
        reports.decision_json(out, chain.names).alias("j"), reports.decision_text(out, chain.names).alias("t"), "label"
    ).orderBy("label").collect()
    document = json.loads(documents[1]["j"])
    assert list(document) == ["annotations", "reject", "rejecting_middleware", "verdict"]
    assert document["reject"]["status_code"] == 403 and document["verdict"] == "rejected"
    assert documents[1]["t"].split("\n") == [
        "guardrail: FAIL (secret_scan: secret_exposure_detected)",
        "  Prompt contains 1 secret value(s); refusing to forward.",
        "  [secret_scan] finding_count=1",
        "    - AWS Access Key ID severity=high preview=AKIA***" + KEY[-2:],
    ]
    assert KEY not in documents[1]["j"] + documents[1]["t"] + second["annotations"]
    assert documents[0]["t"].split("\n")[2:] == [
        "  [secret_scan] finding_count=0",
        f"  [tokenomics] token_count={notes['tokenomics']['token_count']} "
        f"estimated_cost_usd={notes['tokenomics']['estimated_cost_usd']}",
    ]


def test_plain_text_prompts(spark):
    texts = spark.createDataFrame([(1, 'say "hi"\n😀'), (2, "")], "id long, t string")
    asked = normalise.normalise(sources.text_prompts(texts, "t", "id")).orderBy("arrival_seq").collect()
    assert [(r["provider"], r["model"], r["content"]) for r in asked] == [
        ("openai", "gpt-4o", 'say "hi"\n😀'), ("openai", "gpt-4o", ""),
    ]
    direct = sources.text_decisions_input(texts, "t", "id").orderBy("arrival_seq")
    assert [r["content"] for r in direct.collect()] == ['say "hi"\n😀', ""]
    _, out = batch_chain(), batch_chain().decide(direct)
    assert out.where(F.col("verdict") == "allowed").count() == 2


def test_listed_paths_of_any_form(spark, tmp_path, monkeypatch):
    path = folder(tmp_path, **{"a b": chat("m", "x"), "c+d%20[e]": chat("m", "y"), "f": ""})
    monkeypatch.chdir(tmp_path)
    odd, plain = f"{path}/c+d%20[e].json", f"file://{path}/a b.json"
    listed = [odd, plain, "gone.json", "file:///nowhere/x.json", f"{path}/f.json", path, odd]
    rows = sources.read_prompt_list(spark, listed).orderBy("position").collect()
    assert [r["label"] for r in rows] == listed
    assert [r["body"] for r in rows] == [chat("m", "y"), chat("m", "x"), None, None, None, None, chat("m", "y")]


def test_empty_files_of_a_folder_are_input_errors(spark, tmp_path):
    path = folder(tmp_path, **{"a b": chat("m", "fine"), "c": ""})
    (tmp_path / "deep").mkdir()
    for name in ("deep/d.json", "e.txt", "_f.json"):
        (tmp_path / name).write_text("")
    files = sources.read_prompt_files(spark, path)
    rows = {r["label"]: r["body"] for r in files.collect()}
    assert rows == {f"{path}/a b.json": chat("m", "fine"), f"{path}/c.json": None, f"{path}/deep/d.json": None}
    assert reports.gate(scan(files)[1]).first()["gate"] == 2
    assert sources.read_prompt_files(spark, path, recursive=False).count() == 2


def test_stored_reports_hold_no_prompt(spark):
    files = spark.createDataFrame([("a.json", 0, chat("gpt-4o", f"key {KEY}"))], "label string, position bigint, body string")
    chain = batch_chain()
    kept = cut_lineage(reports.without_prompts(chain.decide(normalise.normalise_files(files)), chain.names))
    assert not {"content", "body"} & set(kept.columns)
    assert all(KEY not in str(row) for row in kept.collect())
    lines = [r["line"] for r in reports.report_lines(kept, chain.names).orderBy("position", "line_no").collect()]
    assert lines[0] == "a.json: FAIL (secret_scan: secret_exposure_detected)" and len(lines) == 3


def test_gates_of_several_batches_in_one_pass(spark):
    rows = [("a", None, None), ("b", None, {"status_code": 403, "reason": "r", "detail": "d"}), ("c", "invalid_json", None)]
    decided = spark.createDataFrame(rows, "label string, error_code string, reject struct<status_code:int,reason:string,detail:string>")
    named = {"all": F.lit(True), "ab": F.col("label") < "c", "a": F.col("label") == "a", "none": F.lit(False)}
    out = reports.gates(decided, named)
    assert {r["batch"]: r["gate"] for r in out.collect()} == {"all": 2, "ab": 1, "a": 0, "none": 0}
    for name, rows in named.items():
        assert reports.gate(decided.where(rows)).first()["gate"] == {"all": 2, "ab": 1}.get(name, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_many_files_take_no_call_to_the_jvm_each(spark, tmp_path, monkeypatch):
    rows = [(i, f"body {i}") for i in range(300)] + [(7, "second"), (300, None), (None, "no key")]
    df = spark.createDataFrame(rows, "n long, body string").coalesce(1)
    written = sources.write_prompt_files(df, f"{tmp_path}/w", "n")
    paths = sorted(r["path"] for r in written.collect())
    assert len(paths) == 302
    calls, plain = [], sources._file_system
    monkeypatch.setattr(sources, "_file_system", lambda *given: calls.append(given) or plain(*given))
    files = {r["label"]: r["body"] for r in sources.read_prompt_files(spark, f"{tmp_path}/w", "*.txt").collect()}
    listed = {r["label"]: r["body"] for r in sources.read_prompt_list(spark, paths).collect()}
    assert files == listed and len(calls) <= 3
    got = {p.split("n=")[1]: body for p, body in files.items()}
    assert got["0.txt"] == "body 0\n" and got["300.txt"] == "\n" and got["__HIVE_DEFAULT_PARTITION__.txt"] == "no key\n"
    assert sorted(got["7.txt"].split("\n")) == ["", "body 7", "second"]


def test_files_of_a_folder_are_not_on_the_driver(spark, tmp_path):
    for i in range(300):
        at = tmp_path / f"{i % 3}" / f"{i % 5}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{i}.json").write_text(f"body {i}\n" if i else "")
    files = sources.read_prompt_files(spark, str(tmp_path))
    # Spark's reader keeps the status of each file, and opens as few as one in a task.
    assert files.inputFiles() == [] and "FileScan" not in files._jdf.queryExecution().toString()
    assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    (tmp_path / "later.json").write_text("not there at the call")
    want = {f"{tmp_path}/{i % 3}/{i % 5}/{i}.json": f"body {i}\n" if i else None for i in range(300)}
    rows = files.collect()
    assert len(rows) == 300 and {r["label"]: r["body"] for r in rows} == want
    assert files.dtypes == [("label", "string"), ("position", "bigint"), ("body", "string")]


def test_files_of_many_tasks_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "FILES_A_TASK", 7)
    monkeypatch.setattr(sources, "BYTES_AT_ONCE", 40)
    want = {f"{tmp_path}/{i}.json": "x" * (i % 30) or None for i in range(100)}
    for name, body in want.items():
        with open(name, "w") as file:
            file.write(body or "")
    files = sources.read_prompt_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 15
    assert sorted(map(tuple, files.select("label", "body").collect())) == sorted(want.items())


def test_odd_files_are_read_as_by_spark(spark, tmp_path):
    path = tmp_path / "in"
    kept = {
        "a b.json": b"plain\r\n\0", "c+d%20[e].json": b"odd", "bad.json": b"\xffA\xc3(", "mark.json": b"\xef\xbb\xbf{}",
        "_k=1.json": b"kept", "_p=1/y.json": b"kept", "_metadata/y.json": b"kept", "p=1/q=2/a.json": b"kept",
    }
    passed_by = ("_h.json", ".h.json", "x.json._COPYING_", "_no/y.json", ".no/y.json", "A.JSON", "z.txt")
    for name, content in {**kept, **dict.fromkeys(passed_by, b"not read")}.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(content)
    # Files of no bytes need a plain name, and their folders too.
    for name in ("_e=1.json", "_p=1/e.json", "_metadata/e.json"):
        (path / name).write_bytes(b"")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "o.json").write_bytes(b"out")
    os.symlink(tmp_path / "out", path / "link")
    os.symlink(tmp_path / "gone", path / "gone.json")
    want = {f"{path}/{name}": content for name, content in {**kept, "link/o.json": b"out"}.items()}
    read = lambda *given: {r["label"]: bytes(r["b"]) for r in sources.read_prompt_files(spark, *given).selectExpr("label", "CAST(body AS BINARY) b").collect()}
    assert read(str(path)) == want
    assert read(str(path), "[!a-c]*.{json,txt}").keys() == {n for n in want if n.split("/")[-1][0] not in "abc"} | {f"{path}/z.txt"}
    assert sources.read_prompt_files(spark, f"{path}/{{p=1,p=1/q=2}}").count() == 1
    # Compressed files are Spark's.
    (tmp_path / "out" / "p.json.gz").write_bytes(gzip.compress(b"packed"))
    assert read(f"file://{tmp_path}/out", "*") == {f"{tmp_path}/out/o.json": b"out", f"{tmp_path}/out/p.json.gz": b"packed"}


def test_checksums_of_local_files_are_held_to(spark, tmp_path):
    spark.createDataFrame([("x" * 2_000,)], "v string").coalesce(1).write.text(f"{tmp_path}/w")
    files = sources.read_prompt_files(spark, f"{tmp_path}/w", "*.txt")
    assert files.first()["body"] == "x" * 2_000 + "\n"
    part = next((tmp_path / "w").glob("part*"))
    for damaged in (b"x" * 1_999 + b"y\n", b"x" * 2_000 + b"\nmore"):
        part.write_bytes(damaged)
        with pytest.raises(Exception, match="(?i)checksum error"):
            files.collect()
