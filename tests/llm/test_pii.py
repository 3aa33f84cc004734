"""PII: base spans against a plain reading, context patterns on planted contexts."""

import hashlib
import random
import re

from conftest_paths import SF

from dumplake.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    # Without these signs there is no match, and the plain patterns need not look at very long words.
    some = [k for k, sign in (("email", "@"), ("ip", "."), ("card", ""), ("phone", "+")) if sign in (text or "")]
    return [(k, m.start(), m.end()) for k in some for m in re.finditer(PLAIN[k], text or "") if holds(k, m[0])]


def check(docs, got):
    want = sorted((str(d), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(t)).encode()).hexdigest(), *[sum(k == x for x, _, _ in base(t)) for k in PLAIN]) for d, t in docs)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want


def test_given_and_odd_documents(spark, odd_docs, no_docs, texts):
    got = queries.op9_pii(spark, SF).collect()
    check(texts.items(), got)
    spans = {r.doc_id: r.spans.split(",") if r.spans else [] for r in got}
    assert all({f"{k}:{a}:{b}" for k, a, b in base(t)} <= set(spans[d]) for d, t in texts.items())
    check([(r.doc_id, r.text) for r in odd_docs.collect()], pii.find(odd_docs).collect())
    assert pii.find(no_docs).count() == 0


def test_base_spans_of_random_texts(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "@", ".", "+", "-", " ", "_", "1.2.3.4", "256.1.1.1", "0000255.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-0199", "+12", "x", "é😀", "9" * 25,
             "a.b@c-d.e.f@g.h", "%", "(", ")", "\n", "%x@y.z_", "5"]
    docs = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(1500)]
    check(docs, pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_very_long_runs_take_linear_time(spark):
    docs = [(0, "a" * 400_000), (1, "7" * 400_000), (2, "1 " * 60_000), (3, "a." * 100_000), (4, "x@" + "a." * 100_000), (5, "+1" + " " * 200_000), (6, "1." * 100_000)]
    check(docs, pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_contexts_discover_unseen_identifiers(spark):
    docs = [(i, f"please reach me under phone +1 (555) 555-{1000 + i} today, mail: someone{i}@host{i}.example.org thanks") for i in range(20)]
    docs += [(100, "please reach me under phone 555-555-0177 today"), (101, "no context for 555-555-0178 here"), (102, "mail: person(at)hostname thanks"), (103, "phone home, page 12 of 14")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == "phone:28:40" and got[101] == "" and got[102] == "email:6:24" and got[103] == ""
    assert all(len(got[i].split(",")) == 2 for i in range(20))
