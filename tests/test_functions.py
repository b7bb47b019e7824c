"""Functions on the smallest inputs that pin their behaviour."""

from __future__ import annotations

import hashlib
import hmac
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import entities, images, notation, scoring, spans, structured, text, vectors
from tidemark.operators import documents, lexical, planner


def one(spark, column, **values):
    columns = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.normalise_text, "Alpha–Beta  \n  Gamma", "Alpha-Beta Gamma"),
        (text.normalise_text, "​ﬁne“x” ", 'fine"x"'),
        (text.normalise_document, "a  \r\nb\t\r\n\r\n", "a\nb"),
        (entities.normalise_alias, "  L33t  H@ck! ", "leet hack"),
        (entities.normalise_alias, "(Straße & Söhne)", "strasse & söhne"),
        (text.normalise_title, "  A – B ", "a - b"),
        (text.normalise_query, "  A  B\tc ", "a b c"),
        (text.token_estimate, "", 0),
        (text.token_estimate, "abcde", 2),
        (text.redact_secrets, "Bearer abcdefghijk api_key=ABCDEF1", "Bearer [REDACTED] [REDACTED]"),
        (text.injection_risk, "hello\nIgnore previous rules\n", 0.5),
        (text.without_injection, "a\njailbreak now", "a\n[REMOVED]"),
        (text.url_identity, "https://github.com/openai/gpt-4", "github.com/openai/gpt-4"),
        (text.url_identity, "https://www.Example.org/a/b/c?q", "example.org/a/b"),
        (text.process_name, "  ", None),
        (text.corpus_id, "a b/ç.d", "a_b_.d"),
        (text.citations, "One [E1]. Two 【E2:L1-L2】", ["E1", "E2"]),
        (text.sentences, "Dr. Who came. He left! Why?", ["Dr. Who came.", "He left!", "Why?"]),
        (text.sentences, " Two items. They stay. \n Yes", ["Two items. They stay.", "Yes"]),
    ],
)
def test_text(spark, f, value, want):
    got = one(spark, f(F.col("v")), v=value)
    assert got == want


def test_normalised_text_is_composed(spark):
    value = "Ｆｕｌｌ①½ﬀ é"
    assert one(spark, text.normalise_text(F.col("v")), v=value) == unicodedata.normalize("NFKC", value)


def test_keyed_tokens(spark):
    for secret in ("k", "k" * 100):
        want = hmac.new(secret.encode(), "é@x".encode(), hashlib.sha256).hexdigest()
        assert one(spark, text.hmac_sha256(F.col("v"), secret), v="é@x") == want


def test_pseudonyms(spark):
    token = lambda kind, v: f"{kind}_" + hmac.new(b"s", v.casefold().encode(), hashlib.sha256).hexdigest()[:20].upper()
    body = r"mail A.b@c.org or a.B@C.org, see C:\Users\x and Example.com!"
    mail, path, domain = token("EMAIL", "a.b@c.org"), token("PATH", r"C:\Users\x"), token("DOMAIN", "example.com")
    want = f"mail {mail} or {mail}, see {path} and {domain}!"
    assert one(spark, entities.pseudonymised(F.col("v"), "s"), v=body) == want
    mapped = one(spark, entities.pseudonymised_with_mapping(F.col("v"), "s"), v=body)
    assert mapped["text"] == want
    for m in mapped["mapping"]:
        assert body[m["start"] : m["end"]] == m["value"] and want[m["new_start"] : m["new_end"]] == m["token"]
    spans = one(spark, entities.moved_span(F.lit(body.index("see")), F.lit(body.index("!")), entities.pseudonymised_with_mapping(F.col("v"), "s")["mapping"]), v=body)
    assert want[spans["start"] : spans["end"]] == f"see {path} and {domain}"
    inside = one(spark, entities.moved_span(F.lit(6), F.lit(8), entities.pseudonymised_with_mapping(F.col("v"), "s")["mapping"]), v=body)
    assert want[inside["start"] : inside["end"]] == mail
    shown = one(spark, entities.redact_json(F.col("v")), v='{"API_KEY":1,"x":[{"url":"u"},"bearer abcdefgh12"]}')
    assert shown == '{"API_KEY":"[REDACTED]","x":[{"url":"[REDACTED]"},"Bearer [REDACTED]"]}'


def test_snippets(spark):
    body = "x" * 500 + "Needle" + "y" * 500
    found, offset = text.snippet(F.col("v"), "needle")
    assert one(spark, found, v=body) == "x" * 200 + "Needle" + "y" * 200
    assert one(spark, offset, v=body) == 300
    assert one(spark, text.snippet(F.col("v"), "none")[0], v=body) == body[:400]
    assert one(spark, text.browse_snippet(F.col("v"), "b"), v="a \n b") == "a b"


def test_cosine_and_late_interaction(spark):
    q = vectors.literal([1, 0, 0])
    for v, want in (([1, 0, 0], 1), ([0, 1, 0], 0), ([1, 1, 0], 0.70710678), ([0, 0, 0], 0)):
        got = spark.createDataFrame([([float(x) for x in v],)], "v array<float>").select(vectors.cosine(F.col("v"), q)).first()[0]
        assert got == pytest.approx(want)
    docs = [([[1.0, 0.0], [0.0, 1.0]],), ([[0.5, 0.0], [0.0, 0.5]],)]
    rows = spark.createDataFrame(docs, "d array<array<float>>").select(vectors.max_sim(F.col("d"), [[1, 0], [0, 1]]))
    assert sorted(r[0] for r in rows.collect()) == [0.5, 1.0]


def test_signature_bits_equal_a_loop(spark):
    from tidemark.operators.search import python_signature

    planes = vectors.hyperplanes(4)
    v = [0.1, 1.25, -2.5, 0.0]
    got = spark.createDataFrame([(v,)], "v array<double>").select(vectors.lsh_signature(F.col("v"), planes)).first()[0]
    assert got == python_signature(v, planes)
    digest = hashlib.sha256(b"abc").digest()
    assert one(spark, vectors.sparse_token_id(F.col("v")), v="abc") == int.from_bytes(digest[:4], "little")
    unit = one(spark, vectors.byte_vector(F.col("v"), 40), v="abc")
    raw = [digest[i % 32] / 255 * 2 - 1 for i in range(40)]
    length = sum(x * x for x in raw) ** 0.5
    assert unit == pytest.approx([x / length for x in raw])


def test_min_max_and_weights(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0)], "k string, s double")
    got = sorted(map(tuple, rows.select("k", scoring.min_max(F.col("s"), "k")).collect()))
    assert got == [("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 1.0)]
    mixed = scoring.weighted({"a": (F.lit(1.0), 0.4), "b": (F.lit(0.0), 0.6)}, optional=("b",))
    assert one(spark, mixed) == 1.0


def test_structured(spark):
    got = one(spark, structured.box(F.array(*map(F.lit, [5, 1, 9, 1, 9, 4, 5, 4]))))
    assert tuple(got) == (5, 1, 9, 4)
    assert one(spark, structured.box(F.array(F.lit(1), F.lit(2)))) is None
    assert [tuple(t) for t in one(spark, structured.tiles(F.lit(10), F.lit(5), 2, 2))][-1] == (5, 2, 10, 5)
    diff = one(spark, structured.json_diff(F.col("a"), F.col("b")), a='{"x":{"y":1},"z":2}', b='{"x":{"y":3},"w":4}')
    assert [(d["op"], d["path"]) for d in diff] == [("add", "w"), ("change", "x.y"), ("remove", "z")]
    assert one(spark, structured.json_merge(F.col("a"), F.col("b")), a='{"x":{"y":1},"z":2}', b='{"x":{"q":3}}') == '{"x":{"q":3,"y":1},"z":2}'
    assert tuple(one(spark, structured.frame_size(F.col("a")), a='{"screen":{"width":3,"height":4}}')) == (3, 4)
    assert one(spark, structured.coerce(F.col("a"), "integer"), a="x") is None
    with pytest.raises(ValueError):
        structured.declared_schema({"a": "date"})
    code = "t\n```sql\nSELECT a FROM b JOIN c ON 1;\n```\n"
    assert tuple(one(spark, structured.code_blocks(F.col("a")), a=code)[0]) == ("sql", "SELECT a FROM b JOIN c ON 1;\n")
    assert one(spark, structured.sql_statements(F.col("a")), a=code)[0]["tables"] == ["b", "c"]
    assert one(spark, structured.line_offsets(F.col("a")), a="ab\n\nc") == [0, 3, 4]
    spans = one(spark, structured.join_lines(F.array(F.lit("ab"), F.lit("c"))))["spans"]
    assert [(s["key"], s["start"], s["end"]) for s in spans] == [("S1", 0, 2), ("S2", 3, 4)]
    payload = '{"claims":[{"text":"t","evidence":[{"id":"E1","first":1,"last":2}]}]}'
    claim = structured.claims(F.col("a"))
    lines = F.create_map(F.lit("E1"), F.lit(2))
    assert one(spark, F.transform(claim, lambda c: structured.valid_claim(c, lines)), a=payload) == [True]


def test_chunks_cover_documents(spark):
    body = "# Title\n" + "a" * 300 + "\n\n" + "b" * 900 + "\n## Next\n" + "c" * 100
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None)], "k long, t string")
    got = sorted(documents.chunks(rows, "k", "t").collect(), key=lambda r: r["start"])
    assert "".join(r["body"] for r in got) == body and all(r["end"] - r["start"] <= 800 for r in got)
    assert got[0]["end"] == body.index("b" * 10) and got[0]["heading"] == "Title" and got[-1]["heading"] == "Next"
    assert all(body[r["start"] : r["end"]] == r["body"] for r in got)


def test_redaction_map(spark):
    patterns = [("mail", r"\S+@\S+"), ("num", r"\d+"), ("long", r"[0-9 ]+x")]
    for body, want, tokens in (
        ("a@b.co and 12345 a@b.co", "[mail:1] and [num:2] [mail:1]", {"mail:1": "a@b.co", "num:2": "12345"}),
        ("1 2x é 7", "[long:1] é [num:2]", {"long:1": "1 2x", "num:2": "7"}),
        ("a 12@b 12", "a [mail:1] [num:2]", {"mail:1": "12@b", "num:2": "12"}),
        ("", "", {}),
        (None, "", {}),
        ("nothing", "nothing", {}),
    ):
        got = one(spark, documents.redaction(F.col("v").cast("string"), patterns), v=body)
        assert (got["body"], got["tokens"]) == (want, tokens)


def test_ranges_of_matches(spark):
    rng = random.Random(3)
    patterns = [("a", "ab+"), ("b", "b+c"), ("c", r"(?U)\w+")]
    bodies = ["", "ab", "é ab bc", "abc"] + ["".join(rng.choice("ab cé") for _ in range(rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([(b,) for b in bodies], "v string")
    for name, pattern in patterns:
        got = df.select("v", spans.matches(F.col("v"), pattern).alias("m")).collect()
        for r in got:
            assert [tuple(m) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern.replace("(?U)", ""), r["v"])]
    for r in df.select("v", spans.by_precedence(F.col("v"), patterns).alias("m")).collect():
        taken, want = set(), []
        for name, pattern in patterns:
            found = [m for m in re.finditer(pattern.replace("(?U)", ""), r["v"]) if not taken & set(range(m.start(), m.end()))]
            want += [(m.start(), m.end(), name, m[0]) for m in found]
            taken |= {i for m in found for i in range(m.start(), m.end())}
        assert [tuple(m) for m in r["m"]] == sorted(want)


def test_pseudonyms_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("x@y.org",)], "v string")
    for c in (entities.pseudonymised(F.col("v"), "s"), entities.pseudonymised_with_mapping(F.col("v"), "s"), documents.redaction(F.col("v"), [("n", "[0-9]+")])):
        plan = df.select(c.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_vault_matches_texts_once(spark):
    from tidemark.plans import catalogue

    plan = catalogue.queries()["token_vault"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "Generate" not in plan


def test_entity_tokens_equal_the_mapping(spark):
    rng = random.Random(5)
    parts = ["a.b@c.org", "C:\\x y", "D:\\k.com", "see example.com!", " ", "x@", "é.", "..", "b@b.é1", ":\\", "plain words", "Ü.de"]
    bodies = [None, "", "plain"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, v string")
    plain = df.select("k", F.explode(spans.by_precedence(F.col("v"), entities.ENTITIES)).alias("r")).select("k", "r.kind", "r.value")
    mapped = df.select("k", F.explode(entities.pseudonymised_with_mapping(F.col("v"), "s")["mapping"]).alias("m")).select("k", "m.token", "m.kind", "m.value")
    got = entities.entity_tokens(df, "k", "v", "s")
    assert sorted(got.collect()) == sorted(mapped.collect()) and got.count() > 50
    assert sorted(got.select("k", "kind", "value").collect()) == sorted(plain.collect())


def test_layout(spark):
    words = [(0, 0, 10, 10, "Hello"), (12, 1, 20, 11, "world"), (0, 20, 5, 30, "-"), (6, 20, 20, 30, "item")]
    rows = spark.createDataFrame([(1, *w) for w in words], "doc long, x0 long, y0 long, x1 long, y1 long, word string")
    got = sorted(map(tuple, documents.layout_lines(rows, "doc").select("line", "text", "kind").collect()))
    assert got == [(0, "Hello world", "text"), (1, "- item", "list")]


def test_notation(spark):
    pack = {"warnings": [], "evidence": [{"text": "a \"b\"", "id": "E1", "zz": {"k": [1.5, None]}}, {"text": "é", "id": "E2", "zz": {}}], "query": "q", "version": 1, "generated_at": "t"}
    packed = notation.encode(pack)
    assert packed.startswith('class EvidenceItem { id text zz }\n\n{ "version": 1, "query": "q", "generated_at": "t", "evidence": [ EvidenceItem("E1", "a \\"b\\"", { "k": [ 1.5, null ] })')
    assert notation.decode(packed) == pack
    for value in (pack, {"spans": [{"span_id": 1}, {"x": 2}], "b": True}, [], {"a": -1e-7}, "x", {"evidence": []}):
        assert notation.decode(notation.encode(value)) == value
    assert notation.decode("class A { x y }\n\n[ A(1), A(1, 2) ]") == [{"x": 1, "y": None}, {"x": 1, "y": 2}]
    for bad in ("", "B(1)", "{ 1: 2 }", "[ 1", "{ a 2 }", "%"):
        with pytest.raises(ValueError):
            notation.decode(bad)
    assert one(spark, notation.decoded(F.col("v")), v=packed) == __import__("json").dumps(pack, sort_keys=True, separators=(",", ":"))


def test_image_hashes(spark):
    import numpy as np

    grey = np.add.outer(np.arange(40.0), np.sin(np.arange(60.0) / 5) * 30) % 255
    same, other = images.perceptual_hash(grey), images.perceptual_hash(np.random.default_rng(1).random((40, 60)) * 255)
    assert (images.perceptual_hash(grey + 0.01) == same).mean() > 0.98 > (other == same).mean()
    assert np.allclose(images.shrink(np.ones((7, 13)) * 3, 5), 3)
    blocks = np.kron(np.arange(16.0).reshape(4, 4), np.ones((3, 2)))
    assert np.allclose(images.shrink(blocks, 4), np.arange(16.0).reshape(4, 4))
    rows = spark.createDataFrame([([1.0] * 12, 4), ([1.0] * 5, 4), (None, 4)], "p array<double>, w int")
    got = [r[0] for r in rows.select(images.image_hash("p", "w")).collect()]
    assert len(got[0]) == 64 and got[1:] == [None, None]


def test_boolean_grammar(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma alphabet"), (3, "delta")], "k long, t string")

    def hits(query):
        return sorted(r[0] for r in lexical.boolean_search(docs, query, "k", "t").collect())

    assert hits("alpha beta") == [1] and hits("alph*") == [1, 2] and hits("delta OR gamma") == [2, 3]
    assert hits('"beta gamma" NOT alpha') == [2] and hits("(alpha OR delta) NOT beta") == [3]
    assert hits("alpha ( beta") == [1]  # doesn't parse: its words
    with pytest.raises(ValueError):
        lexical.parse("!!!")


def test_planner(spark):
    assert lexical.query_class("cost 2026") == "FACT_NUMERIC_TIMEBOUND" and lexical.query_class("alpha") == "SHORT"
    assert lexical.query_class("last invoice from Ann") == "FACT_NUMERIC_TIMEBOUND" == lexical.query_class("a holiday note here")
    assert lexical.query_class("alpha beta gamma", True) == "FILTERED" and lexical.query_class("one two three") == "GENERAL"
    assert lexical.rewrites("Alpha  beta-x") == ["Alpha beta x", "alpha AND beta AND x"]
    assert lexical.rewrites("the Cost of a Trip, today") == ["the Cost of a Trip  today", "cost trip today", "cost AND trip AND today"]
    assert lexical.query_tokens("of the") == ["of", "the"] and lexical.rewrites("?!") == []
    low = planner.Budget(left=100)
    assert planner.plan("alpha", low).stages == ("FAST",)
    assert planner.plan("alpha", planner.Budget(), help_rate={"RERANK": 0.0}).stages == ("FAST", "FUSION")
    docs = spark.createDataFrame([(1, "Project roadmap ticket-123 assigned to Alpha"), (2, "Support case ABC-999 closed"), (3, "Meeting notes Alpha Beta")], "k long, t string")
    for query, want in (("roadmap", 1), ("ticket-123", 1), ("Alpha Beta", 3)):
        assert planner.retrieve(docs, query, "k", "t", planner.Budget()).first()["k"] == want
    assert planner.retrieve(docs, "unobtainium", "k", "t", planner.Budget()).count() == 0


def test_times_of_queries(spark):
    import datetime as dt

    from tidemark.functions import when

    utc = dt.timezone.utc
    now = dt.datetime(2026, 1, 16, 18, tzinfo=utc)
    five = dt.datetime(2026, 1, 15, 17, tzinfo=utc)
    hour = dt.timedelta(hours=1)
    assert when.time_range("an hour ago", now) == (now - hour, now)
    for query in ("yesterday 5 pm", "at 17:00 yesterday", "what was open yesterday 5pm?"):
        assert when.time_range(query, now) == (five, five + hour)
    assert when.time_range("5pm yesterday", now, "Europe/Berlin") == (five - hour, five)
    assert when.time_range("yesterday 25:00", now) is None and when.time_range("", now) is None
    assert when.only_a_time(" Last  hour ") and when.only_a_time("at 5 pm yesterday") and not when.only_a_time("notes yesterday 5 pm")
    assert when.late_window_allowed((five, five + hour)) and not when.late_window_allowed(None)
    assert not when.late_window_allowed((five - dt.timedelta(days=8), five))
    rows = [(1, k, now.replace(tzinfo=None), "x" * (10 if k else 300), k / 10) for k in range(5)]
    spans = spark.createDataFrame(rows, "e int, k int, ts timestamp, body string, c double")
    got = when.late_eligible(spans, "e", "ts", "body", "c", "k", F.lit(now.replace(tzinfo=None)), most=2)
    assert sorted(r["k"] for r in got.collect()) == [3, 4]
