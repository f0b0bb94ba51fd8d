import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from fleetlens.llm import secret_scan
from fleetlens.llm.queries import QUERIES


def brute(text):
    """The patterns as the contract spells them, failing matches dropped afterwards."""
    text, spans = text or "", []
    kinds = [
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24)]
    for k, (pattern, flags, fits) in enumerate(kinds):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if fits(m)]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(spans)]


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in secret_scan.scan(text) if s["kind"] != "literal"]


PARTS = st.sampled_from(["password", "PassWord", "passwd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "abc", "0123456789abcdef",
                         "deadbeef", "AKIA", "AKIAZ9", "ABCDEFGH12345678", "ſecret", "toKen", "é", "\n", "\t", "x=y", "+/_.=-", "日", "\U0001f600"])


@given(st.lists(PARTS, max_size=30))
@settings(max_examples=400, deadline=None)
def test_patterns_as_in_the_contract(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {d["doc_id"]: d["text"] for d in docs.collect()}
    rows = QUERIES["op6_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(plain)
    for r in rows:
        want = brute(plain[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in want) for k in secret_scan.KINDS[:3]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("literal")] == [f"{k}:{a}:{b}" for k, a, b in want]


@pytest.mark.parametrize("text, secrets", [
    ('db_pwd = "s3cr3tValue99"', ["s3cr3tValue99"]),
    ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCY", ["wJalrXUtnFEMI/K7MDENG/bPxRfiCY"]),
    ('x = "kD93nf0aPq2L"\nclient_passphrase = x', ["kD93nf0aPq2L"]),
    ('a = "kD93nf0a"\nb = "Pq2LmZ71"\nprivate_key = a + b', ["kD93nf0a", "Pq2LmZ71"]),
    ('{"accessKey": "Zx81kfPq02Lm", "name": "harmless value"}', ["Zx81kfPq02Lm"]),
    ("pwd: changeme", []), ('pwd = "${DB_PASSWORD}"', []), ('title = "kD93nf0aPq2L"', []), ("the key: of it all", []),
    ("keyboard = qwertyuiop123", []), ("pass", []), ("", []), (None, []),
])
def test_literals_of_sensitive_names(text, secrets):
    found = [text[s["start"]:s["end"]] for s in secret_scan.scan(text) if s["kind"] == "literal"]
    assert found == secrets


@pytest.mark.parametrize("text, secrets", [
    ("aws_key_auth = wJalrXUtnFEMI/K7MDENG+bPxRfiCY", ["wJalrXUtnFEMI/K7MDENG+bPxRfiCY"]),
    ("access_key = wJalrXUtn+/K7MDENG+9bPxRfiCY=", ["wJalrXUtn+/K7MDENG+9bPxRfiCY="]),
    ("access_key: wJalrXUtnK7MDENG9bPxRfiC+", ["wJalrXUtnK7MDENG9bPxRfiC+"]),
    ('db_pwd: str = "s3cr3tValue99"', ["s3cr3tValue99"]), ("db_pwd: Optional[str]='s3cr3tValue99'", ["s3cr3tValue99"]),
    ('const accessKey: string | null = "Zx81kfPq02Lm";', ["Zx81kfPq02Lm"]),
    ("static PRIVATE_KEY: &'static str = \"Zx81kfPq02Lm\";", ["Zx81kfPq02Lm"]),
    ('env["DB_PWD"] = "s3cr3tValue99"', ["s3cr3tValue99"]), ("$c['db']['pwd'] = 's3cr3tValue99'", ["s3cr3tValue99"]),
    ('a = "kD93nf0a"\nb = "Pq2LmZ71"\nprivate_key = a+b', ["kD93nf0a", "Pq2LmZ71"]),
    ('a = "kD93nf0a"\nprivate_key = a+"Pq2LmZ71"+a', ["kD93nf0a", "Pq2LmZ71"]),
    ("db_pwd: abc123DEF=xyz789", ["abc123DEF=xyz789"]), ("db_pwd: abc123DEFxyz789=", ["abc123DEFxyz789="]),
])
def test_common_assignments(text, secrets):
    assert [text[s["start"]:s["end"]] for s in secret_scan.scan(text) if s["kind"] == "literal"] == secrets


def test_nothing_is_cut():
    """Aligned columns, long names, constants of many pieces, and long literals between padding."""
    def found(text):
        return [text[s["start"]:s["end"]] for s in secret_scan.scan(text) if s["kind"] == "literal"]

    assert found("db_pwd" + " " * 40 + "=" + "\t" * 40 + '"s3cr3tValue99"') == ["s3cr3tValue99"]
    assert found("a" * 400 + '_pwd = "s3cr3tValue99"') == ["s3cr3tValue99"]
    assert found("x" * 400 + ' = "s3cr3tValue99"\ndb_pwd = ' + "x" * 400) == ["s3cr3tValue99"]
    pieces = [f"kD9{i}nfZ" for i in range(40)]
    text = "x = " + " + ".join(f'"{p}"' for p in pieces) + "\ndb_pwd = x"
    assert found(text) == pieces
    block = "".join(chr(33 + i * 7 % 90) for i in range(6000)).replace('"', "a").replace("\\", "b").replace("'", "c")
    long = "-" * 3000 + block + "-" * 3000
    assert found(f'db_pwd = "{long}"') == [long]
    assert found(f'db_pwd = "{"x" * 9000}"') == []


def test_propagation_takes_linear_time():
    chain = 'p0_pwd = "kD93nf0aPq2L"\n' + "".join(f'p{i}_pwd = p{i - 1}_pwd + "Zx{i}"\n' for i in range(1, 20_000))
    double = 'p0 = "kD93nf0aPq2L"\n' + "".join(f"p{i} = p{i - 1} + p{i - 1}\n" for i in range(1, 5_000)) + "db_pwd = p4999"
    assert len(secret_scan.scan(chain)) == 20_000 and [s["start"] for s in secret_scan.scan(double)] == [6]
    for text in ("key" + " " * 300_000, "key =" + " \t" * 150_000, "pwd = 'a'" + " " * 300_000, ("key" + " " * 500) * 600):
        assert len(secret_scan.scan(text)) < 100


def test_types_take_linear_time():
    for text in ("key: a[" * 40_000, "key: a<b[" * 40_000 + "=", "a: b | " * 40_000, "a:b::" * 60_000, "key=" + "a+" * 150_000 + '"'):
        assert len(secret_scan.scan(text)) < 100_000


def test_prose_is_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    extra = [d["doc_id"] for d in docs if any(s["kind"] == "literal" for s in secret_scan.scan(d["text"]))]
    assert len(extra) <= len(docs) * 0.01


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "=", "token " * 50_000, "pwd = '" + "x" * 300_000, "key=" * 60_000, "a." * 150_000 + " key ="):
        assert len(secret_scan.scan(text)) < 100_000


def test_redaction(spark, odd_docs):
    rows = {r["doc_id"]: r["text"] for r in secret_scan.redact(odd_docs).collect()}
    assert rows[9] == "[secret]" and rows[1] is None and rows[2] == ""


def test_odd_tables(odd_docs, odd_rows, no_docs, clashing_docs):
    for table in (odd_docs, clashing_docs):
        rows = secret_scan.scan_documents(table).collect()
        assert len(rows) == len(odd_rows) and {r["doc_id"]: len(r["spans"]) for r in rows}[9] == 1
    assert secret_scan.scan_documents(no_docs).collect() == []
