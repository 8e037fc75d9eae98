import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import chat, requests
from promptledger.functions import bodies, identity
from promptledger.operators import normalise, redact

OPENAI, ANTHROPIC = "/v1/chat/completions", "/v1/messages"


def content_of(value):
    """Plain restatement of the flattening rule, for comparison."""
    if isinstance(value, str):
        return value
    parts = []
    for part in value if isinstance(value, list) else []:
        if isinstance(part, dict):
            part = part.get("text")
        if isinstance(part, str):
            parts.append(part)
    return "\n".join(parts)


def prompt_of(body, provider):
    texts = [content_of(m.get("content")) for m in body["messages"] if isinstance(m, dict)]
    if provider == "anthropic":
        texts.insert(0, content_of(body.get("system")))
    return "\n".join(t for t in texts if t)


def random_value(rng, depth=0):
    kinds = ["text", "empty", "null", "number", "list", "object", "true"]
    kind = rng.choice(kinds[: 4 if depth > 1 else None])
    if kind == "text":
        return rng.choice(["alpha", "é\n\"q\" \\", "😀", "{}", "[1]", "\t", "a@b.com", "x a@b.com y"])
    if kind == "list":
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == "object":
        keys = rng.sample(["text", "type", "content", "a.b", "z"], rng.randrange(4))
        return {k: random_value(rng, depth + 1) for k in keys}
    return {"empty": "", "null": None, "number": rng.choice([5, 1.5]), "true": True}[kind]


def random_body(rng):
    messages = []
    for _ in range(rng.randrange(1, 5)):
        message = rng.choice([{"role": "user"}, {"role": "user", "content": random_value(rng)}])
        messages.append(rng.choice([message, message, message, random_value(rng)]))
    body = {"temperature": 0.7, "model": "m", "messages": messages}
    if rng.random() < 0.5:
        body["system"] = random_value(rng)
    return body


BODIES = [random_body(random.Random(seed)) for seed in range(200)]
PATHS = [ANTHROPIC, OPENAI]


def random_requests(spark):
    rows = [(PATHS[i % 2], json.dumps(b, ensure_ascii=i % 3 == 0)) for i, b in enumerate(BODIES)]
    return normalise.normalise(requests(spark, rows))


def test_flattening_agrees_with_the_rule(spark):
    got = {r["arrival_seq"]: r for r in random_requests(spark).collect()}
    for i, body in enumerate(BODIES):
        assert got[i]["error_code"] is None
        assert got[i]["content"] == prompt_of(body, got[i]["provider"])


def test_rewrite_keeps_shape_and_everything_else(spark):
    swaps = F.array(
        F.struct(F.lit("a@b.com").alias("original"), F.lit("[REDACTED:X]").alias("replacement")),
        F.struct(F.lit("[RED").alias("original"), F.lit("<").alias("replacement")),
    )
    out = redact.rewrite_requests(random_requests(spark).withColumn("swaps", swaps), "swaps")

    def swapped(value):
        if isinstance(value, str):
            return value.replace("a@b.com", "<ACTED:X]")
        if isinstance(value, list):
            return [
                swapped(p) if isinstance(p, str)
                else {**p, "text": swapped(p["text"])}
                if isinstance(p, dict) and isinstance(p.get("text"), str) else p
                for p in value
            ]
        return value

    for row in out.collect():
        body = json.loads(json.dumps(BODIES[row["arrival_seq"]]))
        if row["provider"] == "anthropic" and "system" in body:
            body["system"] = swapped(body["system"])
        for message in body["messages"]:
            if isinstance(message, dict):
                message["content"] = swapped(message.get("content"))
        assert row["body"] == json.dumps(body, ensure_ascii=False)
        assert row["content"] == prompt_of(body, row["provider"])
        assert row["mutations_applied"]


def test_no_swaps_leave_the_body_as_it_is(spark):
    none = F.array().cast("array<struct<original:string,replacement:string>>")
    raw = ' {"model":"m",  "messages":[{"content":"x"}]} '
    df = normalise.normalise(requests(spark, [(OPENAI, raw)])).withColumn("swaps", none)
    row = redact.rewrite_requests(df, "swaps").first()
    assert row["body"] == raw and not row["mutations_applied"] and row["content"] == "x"


@pytest.mark.parametrize(
    "path, body, code",
    [
        (OPENAI, "", "empty_body"),
        (OPENAI, "not json", "invalid_json"),
        (OPENAI, '{"model":"m","messages":["x"]} tail', "invalid_json"),
        (OPENAI, '{"model":"m","messages":["x"]}{}', "invalid_json"),
        (OPENAI, '{"model":"m","messages":["x"]},{}', "invalid_json"),
        (OPENAI, '{"model":"m","messages":["x"]}],[1', "invalid_json"),
        (OPENAI, "[]", "not_an_object"),
        (OPENAI, '"text"', "not_an_object"),
        (OPENAI, "null", "not_an_object"),
        (OPENAI, "{}", "missing_model"),
        (OPENAI, '{"messages":["x"]}', "missing_model"),
        (OPENAI, '{"model":5,"messages":["x"]}', "missing_model"),
        (OPENAI, '{"model":"","messages":["x"]}', "missing_model"),
        (OPENAI, '{"model":"m"}', "missing_messages"),
        (OPENAI, '{"model":"m","messages":[]}', "missing_messages"),
        (OPENAI, '{"model":"m","messages":"x"}', "missing_messages"),
        ("/v2/other", chat("m", "x"), "unknown_provider"),
        ("/V1/messages", chat("m", "x"), "unknown_provider"),
        ("/", chat("m", "x"), "unknown_provider"),
        (OPENAI + "//", chat("m", "x"), None),
        (OPENAI, " \n" + chat("m", "x") + "\t", None),
        (OPENAI, '{"model":"a","model":"b","messages":["x"]}', None),
    ],
)
def test_errors(spark, path, body, code):
    out = normalise.normalise(requests(spark, [(path, body)]))
    row = out.first()
    assert row["error_code"] == code
    assert row["error_status"] == (None if code is None else 404 if code == "unknown_provider" else 400)
    assert normalise.accepted(out).count() == (code is None)
    assert normalise.dead_letters(out).count() == (code is not None)
    if code is None and '"b"' in body:
        assert row["model"] == "b"


@pytest.mark.parametrize(
    "body, provider",
    [
        ({"model": "gpt-4o"}, "openai"), ({"model": "Claude-3"}, "anthropic"),
        ({"model": "gpt-4o", "system": None}, "anthropic"), ({"model": 5}, "openai"), ({}, "openai"),
    ],
)
def test_provider_detection(spark, body, provider):
    df = bodies.with_parsed(spark.createDataFrame([(json.dumps(body),)], "body string"), "body", "v")
    assert df.select(bodies.detect_provider(F.col("v"))).first()[0] == provider


def test_request_ids(spark):
    good = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    spellings = [good, good.upper(), "{" + good + "}", "urn:uuid:" + good, good.replace("-", "")]
    rows = [(s,) for s in spellings] + [("nope",), (None,), ("",), (good[:-1],)]
    df = spark.createDataFrame(rows, "given string").withColumn("n", F.monotonically_increasing_id())
    made = df.select(identity.request_id(F.col("given"), F.lit("s"), F.col("n")).alias("id"))
    ids = [r["id"] for r in made.collect()]
    assert ids[:5] == [good] * 5
    assert len(set(ids[5:])) == 4 and all(len(i) == 36 and i[14] == "4" for i in ids[5:])
    assert ids == [r["id"] for r in made.collect()]


def test_header_name_in_any_case(spark):
    df = spark.createDataFrame([({"A": "1", "X-Request-ID": "v"},)], "h map<string,string>")
    assert df.select(identity.header(F.col("h"), "x-request-id")).first()[0] == "v"


def test_custom_route(spark):
    routes = (*bodies.ROUTES, bodies.ProviderRoute("/v1/mine", "mine", system_field="preamble"))
    df = requests(spark, [("/v1/mine/", chat("m", "x"))])
    row = normalise.normalise(df, routes).first()
    assert (row["provider"], row["content"]) == ("mine", "x")


def test_route_with_its_own_layout_is_scanned_and_redacted(spark):
    from promptledger.plans.chain import Chain, PiiStage

    mine = bodies.ProviderRoute("/v1/mine", "mine", "preamble", "turns", "say")
    routes = (*bodies.ROUTES, mine)
    body = '{"model": "m", "preamble": "mail a@b.com", "turns": [{"say": "hi"}, {"say": [{"text": "c@d.org"}]}]}'
    bare = '{"model": "m", "preamble": "x", "messages": [{"content": "y"}]}'
    df = normalise.normalise(requests(spark, [("/v1/mine", body), ("/v1/mine", bare)]), routes)
    first, second = df.orderBy("arrival_seq").collect()
    assert first["content"] == "mail a@b.com\nhi\nc@d.org"
    assert second["error_code"] == "missing_messages"
    decided = Chain([PiiStage("redact")], routes).decide(df).orderBy("arrival_seq").first()
    assert decided["content"] == "mail [REDACTED:EMAIL_ADDRESS]\nhi\n[REDACTED:EMAIL_ADDRESS]"
    assert json.loads(decided["body"])["turns"][1]["say"][0]["text"] == "[REDACTED:EMAIL_ADDRESS]"


def test_bodies_that_resist_rewriting(spark):
    from promptledger.plans.chain import Chain, PiiStage

    lone = '{"model": "m", "messages": [{"content": "a@b.com \\\\ud800 é"}]}'.replace("\\\\", "\\")
    digits = '{"model": "m", "n": ' + "9" * 5_000 + ', "messages": [{"content": "a@b.com"}]}'
    df = normalise.normalise(requests(spark, [("/v1/chat/completions", b) for b in (lone, digits)]))
    first, second = Chain([PiiStage("redact")]).decide(df).orderBy("arrival_seq").collect()
    text = json.loads(first["body"])["messages"][0]["content"]
    assert text == "[REDACTED:EMAIL_ADDRESS] \ud800 é"
    assert second["error_code"] is not None and second["verdict"] is None
    assert "a@b.com" not in (second["body"] or "") or second["error_code"] == "invalid_json"
