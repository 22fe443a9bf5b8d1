import time
import re
from collections import defaultdict
from math import log2

from hypothesis import given, settings
from hypothesis import strategies as st
from newsignal.llm import pii, queries
from texts import prose

SF = "/root/testdata/sf0.001"


def luhn(digits):
    twice = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def brute(text):
    """The stated patterns, as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+ 0129(é_%", max_size=40) | st.from_regex(r"([0-9]{4}[ -]?){4}|(a@b\.c@d\.e|1\.2\.3\.4\.5)+", fullmatch=True))
def test_patterns_equal_the_stated_ones(text):
    assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a." * 150_000 + "@", "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def shared_terms():
    rows = []
    for i in range(6):
        rows.append((i, f"{prose(i, 15)} Zyxwin met Person{i % 2} ann@corp.example near {prose(90 + i, 15)}"))
    rows += [(50 + i, f"{prose(200 + i, 20)} met near {prose(300 + i, 20)}") for i in range(20)]
    return rows + [(90, None), (91, ""), (0, rows[0][1])]


def test_disclosing_terms_equal_brute_force(documents):
    rows = shared_terms()
    texts = [t or "" for _, t in rows]
    near = [pii.contexts(t, brute(t)) for t in texts]
    n_term, n_entity, n_both, different = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for text, around in zip(texts, near):
        for term in set(re.findall(r"\w{3,}", text.lower())):
            n_term[term] += 1
        for e in {c["entity"] for c in around}:
            n_entity[e] += 1
        for pair in {(c["entity"], c["term"]) for c in around}:
            n_both[pair] += 1
            different[pair].add(text)
    action = {}
    for (e, t), n in n_both.items():
        if len(different[e, t]) > 1:
            gives = min(log2(n * len(rows) / (n_entity[e] * n_term[t])) / log2(len(rows) / n_entity[e]), 1)
            if gives >= 0.7 - 1e-12:
                action[e, t] = "remove" if gives >= 0.9 else "generalise"
    wanted = []
    for (i, _), text, around in zip(rows, texts, near):
        more = sorted({(action[c["entity"], c["term"]], c["start"], c["end"]) for c in around if (c["entity"], c["term"]) in action},
                      key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        wanted.append((i, brute(text) + more))
    found = pii.personal_spans(documents(rows)).collect()
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(s[0] == "remove" for _, spans in got for s in spans)


def test_sanitised_text(documents):
    docs = documents(shared_terms()).withColumnRenamed("source", "digest")
    out = pii.sanitised(docs)
    assert out.columns == [*docs.columns, "sanitised"]
    got = {r.doc_id: r.sanitised for r in out.collect()}
    assert "[EMAIL]" in got[1] and "ann@corp" not in got[1] and "Zyxwin" not in got[1]
    assert got[55] == shared_terms()[11][1] and got[90] is None and got[91] == ""


def test_odd_rows(documents, odd_rows):
    assert pii.personal_spans(documents(odd_rows)).count() == len(odd_rows)
    assert pii.personal_spans(documents([])).count() == 0


def test_query_keeps_the_base(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_pii(spark, SF).collect():
        spans = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone")
        )


def test_many_entities_in_one_text_take_time_in_proportion():
    text = " ".join(f"name{i} user{i}@mail.example from town{i % 7}," for i in range(100_000))
    start = time.perf_counter()
    spans = pii.base_spans(text)
    found = pii.contexts(text, spans)
    assert len(spans) == 100_000 and time.perf_counter() - start < 30
    middle = [c for c in found if c["entity"] == "email:user50000@mail.example"]
    assert {c["term"] for c in middle} >= {"name50000", "from", "town6"} and len(middle) < 20
    assert not any("user" in c["term"] or "mail" in c["term"] for c in middle)


def test_far_words_are_in_the_context():
    text = "w" * 900 + " met a@b.example and " + "x" * 900
    terms = {c["term"] for c in pii.contexts(text, pii.base_spans(text))}
    assert terms == {"w" * 900, "met", "and", "x" * 900}
