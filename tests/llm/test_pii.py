import hashlib
import random
import re

from vexil.llm import pii


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for alphabet in ("0123456789..--  ++@@ab()_", "aZ09._%+-@@..é\n", "4111 1111-1111 1111 0", "+1 (555) 010-9999..", "255.0.1.."):
        for _ in range(4000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert [x for x in pii.scan(s) if x[1] < 4] == base(s), s


def test_added_kinds_and_bounds():
    text = "See https://a.example/x?y=1. IBAN: DE89370400440532013000, password=abcd1234efgh ok"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.scan(text)] == [("url", "https://a.example/x?y=1"), ("account", "DE89370400440532013000"), ("secret", "abcd1234efgh")]
    assert pii.redact("mail a@b.example now") == "mail <email> now" and pii.redact(None) is None
    assert pii.scan("the account was closed in May, her token of thanks") == []


def test_account_boundaries_are_validated():
    spans = lambda text: [(pii.KINDS[k], text[s:e]) for s, k, e in pii.scan(text) if k > 3]
    assert spans("iban: DE00370400440532013000") == [] and spans("to GB82WEST12345698765432.") == [("account", "GB82WEST12345698765432")]
    assert spans("to GB82 WEST 1234 5698 7654 32.") == [("account", "GB82 WEST 1234 5698 7654 32")] and spans("part AB12CDEFGH345678901 of it") == []
    assert spans("Tax ID: 123456789") == [("account", "123456789")] and spans("Api Key: abcdEFGH1234") == [("secret", "abcdEFGH1234")]
    assert spans("SSN 078-05-1120") == [("account", "078-05-1120")] and spans("ssn 000-05-1120") == [] and spans("Customer ID no. 4411987") == [("account", "4411987")]
    assert spans("xGB82WEST12345698765432") == []


def test_long_words_take_linear_time():
    assert pii.scan("a" * 1_000_000) == [] and pii.scan("1" * 1_000_000) == [] and pii.scan("@" * 300_000) == [] and pii.scan("1." * 3) == []


def test_query_rows(docs, empty, rows):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows) and got[74]["spans"] == "" and got[74]["n_email"] == 0
    assert pii.find(empty).count() == 0


def test_digest_spans_and_counts_of_the_query(spark):
    """Every row against the patterns, with null and repeated ids and a column of the result's name."""
    rng = random.Random(3)
    bits = ["a.b@c.example", "10.0.0.255", "4111 1111 1111 1111", "+1 (555) 010-9999", "word", "é🙂", "256.1.1.1", "https://x.example/a", "\n"]
    made = [(None if i % 7 == 0 else i % 20, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))), "x") for i in range(60)] + [(3, None, "x"), (3, "", "x")]
    got = pii.find(spark.createDataFrame(made, "doc_id long, text string, spans string").coalesce(1)).collect()
    assert len(got) == len(made)
    for (doc, text, _), r in zip(made, got, strict=True):
        want = base(text or "")
        shown = ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in want)
        assert r["doc_id"] == doc and r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[1] == k for x in want) for k in range(4)]
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE] == [x for x in shown.split(",") if x]
