import re

import pytest
from pyspark.sql import functions as F

from helpers import SECRETS, noise, prompts
from promptledger.functions import recognisers as pii
from promptledger.functions.findings import preview_sql, severity_rank, worst_severity
from promptledger.functions.rules import CATALOGUE, SecretRule
from promptledger import session
from promptledger.operators import detect


def mask(m):
    return "*" * len(m) if len(m) <= 6 else f"{m[:4]}***{m[-2:]}"


def by_re(text, rules=CATALOGUE):
    """Brute force with Python's own regular expressions."""
    found = [
        (m.start(), i, m.end(), r.name, r.label, r.severity, mask(m.group()))
        for i, r in enumerate(rules)
        for m in re.finditer(r.pattern, text)
    ]
    return [(k, label, sev, s, e, p) for s, _, e, k, label, sev, p in sorted(found)]


def scanned(df):
    rows = df.collect()
    return {r["arrival_seq"]: r["findings"] and [tuple(f) for f in r["findings"]] for r in rows}


def test_secrets_agree_with_python_regex(spark):
    texts = [noise(seed) for seed in range(150)] + ["", "clean", *SECRETS.values()]
    got = scanned(detect.scan_secrets(prompts(spark, *texts)))
    assert sum(map(len, got.values())) > 200
    for i, text in enumerate(texts):
        assert got[i] == by_re(text), text


@pytest.mark.parametrize("rule", CATALOGUE, ids=lambda r: r.name)
def test_each_rule_finds_its_own_format_once(spark, rule):
    text = f"see {SECRETS[rule.name]} now"
    (found,) = scanned(detect.scan_secrets(prompts(spark, text), rules=[rule]))[0]
    assert found[0] == rule.name and found[2] == rule.severity
    assert text[found[3] : found[4]] == SECRETS[rule.name]
    assert SECRETS[rule.name] not in found[5]


def test_null_text_gives_null_and_no_rules_give_none(spark):
    df = prompts(spark, None, "x")
    assert [r["findings"] for r in detect.scan_secrets(df).orderBy("arrival_seq").collect()] == [None, []]
    assert scanned(detect.scan_secrets(prompts(spark, noise(1)), rules=[]))[0] == []


def test_custom_rule_with_quotes_and_without_markers(spark):
    rule = SecretRule("it's", "Bob's \\ key", r"key='\d+'", "low")
    (found,) = scanned(detect.scan_secrets(prompts(spark, "a key='42' b"), rules=[rule]))[0]
    assert found == ("it's", "Bob's \\ key", "low", 2, 10, "key=***2'")


def test_many_matches_in_one_text(spark):
    text = " ".join([SECRETS["aws_access_key_id"]] * 3000)
    found = scanned(detect.scan_secrets(prompts(spark, text)))[0]
    assert found == by_re(text)


def test_preview_and_severity_order(spark):
    row = spark.range(1).select(
        F.expr(preview_sql("'123456'")).alias("short"), F.expr(preview_sql("'1234567'")).alias("long"),
        severity_rank(F.lit("high")).alias("high"),
    ).first()
    assert tuple(row) == ("******", "1234***67", 2)
    both = f"{SECRETS['jwt']} {SECRETS['slack_token']}"
    df = detect.scan_secrets(prompts(spark, both, SECRETS["jwt"], "none"))
    worst = df.select("arrival_seq", worst_severity(F.col("findings"))).orderBy("arrival_seq").collect()
    assert [r[1] for r in worst] == ["high", "medium", None]


# ---------------------------------------------------------------- personal data

TEXT = (
    "mail a@b.com, call 838-555-7235 ip 10.0.0.1 card 4111 1111 1111 1111 "
    "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00 end"
)


def labels(spark, text, **options):
    return [f[1] for f in scanned(detect.scan_pii(prompts(spark, text), **options))[0]]


def test_entities_in_order_of_start_with_spans(spark):
    found = scanned(detect.scan_pii(prompts(spark, TEXT)))[0]
    assert [f[1] for f in found] == [
        "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD", "US_SSN", "IBAN_CODE",
    ]
    assert TEXT[found[0][3] : found[0][4]] == "a@b.com"
    assert all(f[0] == "pii_" + f[1].lower() for f in found)
    assert [f[2] for f in found] == ["high", "medium", "medium", "high", "low", "high"]


@pytest.mark.parametrize(
    "text",
    [
        "", "clean text", "card 4111 1111 1111 1112", "ssn 000-12-3456", "ssn 912-12-3456",
        "ssn 123-00-4567", "ip 10.0.0.256", "iban DE88 3704 0044 0532 0130 00", "fig 212-555-1234",
    ],
)
def test_invalid_or_weak_values_are_not_found(spark, text):
    assert labels(spark, text) == []


def test_entity_subset_and_threshold(spark):
    text = "phone 212-555-1234, mail a@b.com"
    assert labels(spark, text, entities=["EMAIL_ADDRESS"]) == ["EMAIL_ADDRESS"]
    assert labels(spark, "fig 212-555-1234", threshold=0.4) == ["PHONE_NUMBER"]
    assert labels(spark, text, threshold=0.9) == ["EMAIL_ADDRESS"]
    with pytest.raises(ValueError):
        labels(spark, text, threshold=1.1)
    with pytest.raises(ValueError):
        labels(spark, text, entities=["SHOE_SIZE"])


def test_gates_never_hide_a_match(spark):
    """Every gate is implied by its pattern on texts that match."""
    samples = {
        "EMAIL_ADDRESS": "a@b.com", "PHONE_NUMBER": "(838)555 7235",
        "CREDIT_CARD": "4111-1111-1111-1111", "IBAN_CODE": "DE89370400440532013000",
        "US_SSN": "123-45-6789", "IP_ADDRESS": "1.1.1.1",
    }
    for r in pii.RECOGNISERS:
        assert re.search(r.pattern, samples[r.entity])
        begins = f"(?=[{r.gate_start}])(?:{r.gate or re.escape(r.marker)})"
        assert re.search(begins if r.gate else re.escape(r.marker), samples[r.entity])


def test_no_builtin_match_crosses_a_line(spark):
    """So a value can not hide from redaction between two messages."""
    text = TEXT.replace(" ", "\n").replace("-", "\n")
    for f in scanned(detect.scan_pii(prompts(spark, text), threshold=0.0))[0]:
        assert "\n" not in text[f[3] : f[4]]


@pytest.mark.parametrize("inline, rows", [(5_000, 0), (0, 50_000), (0, 0)], ids=["inline", "broadcast", "salted"])
def test_names_from_a_table(spark, monkeypatch, inline, rows):
    from promptledger import session

    join = session.lookup_join
    monkeypatch.setattr(detect, "INLINE_NAMES", inline)
    monkeypatch.setattr(detect, "lookup_join", lambda *a: join(*a, max_rows=rows))
    names = spark.createDataFrame([("Ana Silva",), ("Ana",), ("Ana",), ("Zoë",)], "name string")
    text = "😀 Bob Ana Silva met Ana,  Zoë and Ana  Silva"
    found = scanned(detect.scan_pii(prompts(spark, text, "nobody", None), names=names))
    assert [text[f[3] : f[4]] for f in found[0]] == ["Ana Silva", "Ana", "Zoë", "Ana  Silva"]
    assert found[1] == [] and labels(spark, text) == []
    exact = scanned(detect.scan_pii(prompts(spark, text), names=names, any_space=False))[0]
    assert [text[f[3] : f[4]] for f in exact] == ["Ana Silva", "Ana", "Zoë", "Ana"]


def test_custom_recogniser(spark):
    badge = pii.Recogniser("BADGE", r"\bB-\d{4}\b", 0.7)
    (found,) = scanned(detect.scan_pii(prompts(spark, "my B-1234"), recognisers=[badge]))[0]
    assert found == ("pii_badge", "BADGE", "medium", 3, 9, "******")


@pytest.mark.parametrize("inline", [5_000, 0], ids=["inline", "joined"])
def test_names_of_any_form_and_rows_of_one_number(spark, monkeypatch, inline):
    monkeypatch.setattr(detect, "INLINE_NAMES", inline)
    listed = ["O'Brien", "Jean-Luc Picard", "Anna Maria de la Cruz", "John Smith", "Maria", " ", None]
    names = spark.createDataFrame([(n,) for n in listed], "name string")
    text = "John Smith, O'Brien and Jean-Luc Picard met Anna Maria de la Cruz; Maria, O Brien."
    found = scanned(detect.scan_pii(prompts(spark, text), names=names))[0]
    assert [text[f[3] : f[4]] for f in found] == [
        "John Smith", "O'Brien", "Jean-Luc Picard", "Anna Maria de la Cruz", "Maria",
    ]
    twice = spark.createDataFrame([(1, text), (1, "nobody"), (1, text)], "arrival_seq long, content string")
    sizes = [len(r["findings"]) for r in detect.scan_pii(twice, names=names).collect()]
    assert sorted(sizes) == [0, 5, 5]


@pytest.mark.parametrize("inline", [5_000, 0], ids=["inline", "joined"])
def test_names_with_any_white_space_between_words(spark, monkeypatch, inline):
    from promptledger.operators.redact import redact_texts
    from promptledger.plans.chain import PiiStage

    monkeypatch.setattr(detect, "INLINE_NAMES", inline)
    names = spark.createDataFrame([("John Smith",), ("Anna\tde  la Cruz",)], "name string")
    forms = ["John Smith", "John  Smith", "John\nSmith", "John\tSmith", "John\u00a0Smith", "Anna de\r\nla Cruz"]
    text = "; ".join(forms) + "; JohnSmith, John, Smith"
    found = scanned(detect.scan_pii(prompts(spark, text), names=names, any_space=True))[0]
    assert [text[f[3] : f[4]] for f in found] == forms
    (row,) = redact_texts(prompts(spark, text), names=names).collect()
    assert row["content"] == "; ".join(["[REDACTED:PERSON]"] * 6) + "; JohnSmith, John, Smith"
    stage = PiiStage(names=names)
    (row,) = stage.apply(prompts(spark, text).withColumn("open_content", F.col("content"))).collect()
    assert row["pii_scan"]["finding_count"] == 6 and row["pii_scan_reject"] is not None


@pytest.mark.parametrize(
    "address",
    ["x" * 70 + "@mail.org", "a@" + "b." * 13 + "com", "a@b.xn--p1ai", "a.b-c%d+e_f@g.museum", "q@" + "d" * 90 + ".de"],
)
def test_addresses_of_any_length(spark, address):
    text = f"to {address}, and on"
    (found,) = scanned(detect.scan_pii(prompts(spark, text), entities=["EMAIL_ADDRESS"]))[0]
    assert text[found[3] : found[4]] == address


def test_address_right_after_an_address(spark):
    text = "a@b.com.x@y.com"
    found = scanned(detect.scan_pii(prompts(spark, text), entities=["EMAIL_ADDRESS"]))[0]
    assert [text[f[3] : f[4]] for f in found] == ["a@b.com", ".x@y.com"]  # a dot may begin a local part


def test_spans_beyond_one_block_of_offsets(spark):
    text = " ".join(f"é{i} mail{i}@host.org" for i in range(1_300))
    found = scanned(detect.scan_pii(prompts(spark, text), entities=["EMAIL_ADDRESS"]))[0]
    assert [text[f[3] : f[4]] for f in found] == [f"mail{i}@host.org" for i in range(1_300)]


def test_time_grows_with_the_length_of_a_text(spark):
    import time

    names = spark.createDataFrame([("Ana Silva",)], "name string")

    def seconds(n):
        df = prompts(spark, " ".join(f"word{i} a{i}@b.org" for i in range(n)))
        started = time.monotonic()
        detect.scan_pii(df, names=names).selectExpr("sum(size(findings))").collect()
        return time.monotonic() - started

    seconds(1_000)
    assert seconds(40_000) < 3 * seconds(20_000) + 1


def test_runs_that_are_no_name_are_not_shuffled_to_a_long_table(spark, monkeypatch):
    texts = [f"then Ann{i} Lee{i} met Bob Ray and Ann{i} Bob on day {i} of Bob Ray" for i in range(300)] + [None, ""]
    names = spark.createDataFrame([(f"Ann{i} Lee{i}",) for i in range(0, 600, 2)] + [("Bob Ray",), ("Ray",), (None,)], "name string")
    df = prompts(spark, *texts, *texts[:20])
    scanned = lambda: sorted(map(repr, detect.scan_pii(df, entities=[pii.PERSON], names=names).collect()))
    inline = scanned()
    passed, plain = [], session.possible_facts
    monkeypatch.setattr(detect, "INLINE_NAMES", 10)
    monkeypatch.setattr(session, "fits_broadcast", lambda *given: False)
    monkeypatch.setattr(session, "possible_facts", lambda *a: passed.append(plain(*a).count()) or plain(*a))
    assert scanned() == inline and sum("PERSON" in r for r in inline) == 320
    assert 150 + 4 * 300 <= passed[0] <= 150 + 4 * 300 + 10


def test_rows_are_not_sorted_to_meet_their_hits_of_a_long_table(spark, monkeypatch):
    monkeypatch.setattr(detect, "INLINE_NAMES", 0)
    names = spark.createDataFrame([("Ann Lee",), ("Lee",), ("Bo",)], "name string")
    df = prompts(spark, "Ann  Lee met Bo", "Ann  Lee met Bo", "nobody", None, "Ann  Lee met Bo")
    hit = detect.with_pii_hits(df, "content", "hits", entities=["PERSON"], names=names)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r.arrival_seq: r.hits and [h.matched for h in r.hits] for r in hit.collect()}
    whole = ["Ann  Lee", "Bo"]
    assert got == {0: whole, 1: whole, 2: [], 3: None, 4: whole}
