"""Parts of credentials directly after an equals sign; the wanted spans are built by hand, not by the operator's patterns."""

from loomlog.llm import secrets

ACCESS, PART, ENDPOINT = "AKIA" + "Q7" * 8, "Ab1/" * 10, "https://example.org/x"


def laid_out(*pieces):
    """A text of pieces and, of those with a kind, their spans."""
    text, spans = "", []
    for kind, piece in pieces:
        if kind:
            spans.append(f"{kind}:{len(text)}:{len(text) + len(piece)}")
        text += piece
    return text, ",".join(spans)


def test_secret_after_an_equals_sign(spark):
    cases = [
        laid_out(("", "AWS_ACCESS_KEY_ID="), ("access", ACCESS), ("", "\nAWS_SECRET_ACCESS_KEY="), ("part", PART), ("", "\nAWS_URL="), ("endpoint", ENDPOINT)),
        laid_out(("access", ACCESS), ("", " KEY="), ("part", PART)),
        laid_out(("access", ACCESS), ("", " KEY= "), ("part", PART), ("", ' KEY="'), ("part", PART), ("", '"')),
        laid_out(("access", ACCESS), ("", " KEY=" + PART + "= " + PART + "x")),
        laid_out(("", "KEY=" + PART)),
    ]
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "doc_id LONG, text STRING")
    found = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    assert found == {n: spans for n, (_, spans) in enumerate(cases)}
