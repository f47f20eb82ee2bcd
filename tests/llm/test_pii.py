import math
import random
import re
import time
from hashlib import sha256

from tests.llm.fixtures import empty, rows, table
from verso.llm import pii

KINDS = ("email", "ip", "card", "phone")
PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail a.b@c.d.e_f@g.h and x@y z@@w.q k@l.m. 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 é 4111 1111 1111 1111, 4111-1111-1111-1112",
    "+1 (648) 555-6701 +12 +3 ((( +49 30 1234567 89 0123456789 tail+1 23",
    "ü@x.de é.e@f-g.com,h@i.j\n79927398713 49927398716 378282246310005 5 5 5 5 5 5",
    "@a.b a@.b a@b. 9" + "9" * 3000 + " " + "a" * 5000 + "@",
    "1-2 3--4 5- 6 0000000000000000 123456789012345678901234567890",
]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = sorted((m.start(), j, m.end(), k) for j, k in enumerate(KINDS) for m in re.finditer(PATTERN[k], text or "") if valid(k, m[0]))
    return [sum(s[3] == k for s in spans) for k in KINDS] + [sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()]


def test_base_spans(spark):
    data = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + rows()
    found = pii.find(table(spark, data)).collect()
    assert len(found) == len(data)
    texts = {}
    for r in data:
        texts.setdefault(r[0], set()).add(r[1])
    for r in found:
        assert any(brute(t) == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] for t in texts[r["doc_id"]])


def test_very_many_spans(spark):
    texts = [" ".join(f"u{i}@m{i % 7}.org" for i in range(n)) for n in (255, 256, 257, 3000)]
    found = {r["doc_id"]: r for r in pii.find(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert brute(t) == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]]


def planted():
    near = [(i, f"the person zanzibar wrote from secret.one@mail.com about report number {i} today", "en", "s", 1) for i in range(4)]
    far = [(100 + i, f"the person wrote about report number {i} today and nothing else was said by anyone here", "en", "s", 1) for i in range(60)]
    return near + far


def test_disclosing_terms_are_added(spark):
    found = {r["doc_id"]: r for r in pii.find(table(spark, planted())).collect()}
    for i in range(4):
        text = planted()[i][1]
        spans = [s.split(":") for s in found[i]["spans"].split(",")]
        marked = {text[int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert "zanzibar" in marked and not marked & {"person", "report", "today", "about"}
        assert [text[int(a) : int(b)] for k, a, b in spans if k == "email"] == ["secret.one@mail.com"]
    assert all(found[100 + i]["spans"] == "" for i in range(60))


def marked_terms(spark, texts):
    found = pii.find(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in found}
    return [{texts[i][int(a) : int(b)] for k, a, b in spans[i] if k == "term"} for i in range(len(texts))]


def test_terms_far_from_the_entity_short_ones_and_rows_without_it(spark):
    filler = "the person wrote about the report today and nothing else was said by anyone here " * 4
    both = [f"Ann Zanzibar 王明 {filler} {i} mail secret.one@mail.com" for i in range(4)]
    alone = [f"{filler} then ANN and zanzibar met 王明, not Anna"]
    found = marked_terms(spark, both + alone + [f"{filler} mail {i}" for i in range(59)])
    assert found[:4] == [{"Ann", "Zanzibar", "王明"}] * 4
    assert found[4] == {"ANN", "zanzibar", "王明"}
    assert not any(found[5:])


def test_two_texts_are_told_apart(spark):
    # A distinct count by sketches takes the hashes of these two texts for one.
    both = [f"zork sits here {i} x@y.org" for i in (0, 15053)]
    found = marked_terms(spark, both + [f"nothing of note was said by anyone {i}" for i in range(60)])
    assert found[:2] == [{"zork", "sits", "here"}] * 2 and not any(found[2:])


def test_terms_against_brute_force(spark):
    rng = random.Random(5)
    people = [[f"p{c}@x.org" for c in "abcdef"][i % 6] for i in range(12)]
    texts = []
    for i in range(80):
        body = [rng.choice("alpha beta gamma delta li wu epsilon zeta eta theta iota kappa".split()) for _ in range(3)]
        body += [f"{'qrstuv'[i % 6] * 2}"] if i < 12 or i in (30, 31) else []
        texts.append(" ".join(body) + (" " + "x9 " * 60 + people[i] if i < 12 else ""))
    texts.append(texts[0])
    terms = [set(re.findall("[a-z]+", t)) for t in texts]
    entities = [set(re.findall(r"p[a-f]@x\.org", t)) for t in texts]
    n, telling = len(texts), set()
    for e in set().union(*entities):
        holds = [i for i in range(n) if e in entities[i]]
        for t in set().union(*(terms[i] for i in holds)):
            both = [i for i in holds if t in terms[i]]
            n_t = sum(t in x for x in terms)
            if len({texts[i] for i in both}) > 1 and math.log(n * len(both) / (n_t * len(holds))) >= 0.9 * math.log(n / len(holds)):
                telling.add(t)
    words = [set(re.findall("[a-z]+", re.sub(r"\S+@\S+", "", t))) for t in texts]
    assert telling and marked_terms(spark, texts) == [w & telling for w in words]


def test_sanitise(spark):
    df = table(spark, planted() + rows())
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {(r["_key"], r["_all"]) for r in out.collect()} == {("key", "a")}
    texts = [r["text"] for r in out.filter("doc_id < 4 and text like '%EMAIL%'").collect()]
    assert texts and all("secret" not in t and "zanzibar" not in t and "<TERM>" in t for t in texts)
    assert pii.find(empty(spark)).count() == 0 and pii.sanitise(empty(spark)).count() == 0


def test_a_list_of_very_many_names_and_addresses(spark):
    """Each rare term of a row once met each of its entities: 16 million pairs here."""
    n = 4000
    name = lambda i: "n" + "".join(chr(97 + int(d)) for d in str(i))
    body = " ".join(f"{name(i)} {name(i)}@x{i}.org" for i in range(n))
    data = [(1, body, "en", "s", 1), (2, body + " end", "en", "s", 1)] + [(10 + i, f"other text number {i}", "en", "s", 1) for i in range(30)]
    began = time.time()
    found = {r["doc_id"]: r for r in pii.find(table(spark, data)).collect()}
    assert time.time() - began < 60
    # Every name stands in both texts and nowhere else, as every address does; inside addresses the base span stays alone.
    assert found[1]["n_email"] == n and found[1]["n_base"] == n and found[1]["n_term"] == n
    assert found[10]["n_term"] == 0


def test_classes_are_those_of_equal_rows(spark):
    rows = [("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("a", 2, 5), ("b", 2, 5), ("c", 3, 5), ("d", 1, 6), ("d", 2, 6)]
    df = spark.createDataFrame(rows, "name string, _key long, n long")
    assert {r["name"]: r["_first"] for r in pii._classes(df, "name", "n").collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
