import hashlib
import re

import regex
from pyspark.sql import functions as F

from tessera.llm import pii

TEXTS = {
    1: "Call +1 (988) 555-2485 or 988-555-2485; Mail Bosbt.42@mail8.example.com, bosbt.42@mail8.example.com.",
    2: "card 4111 1111 1111 1111 and 4041894974608795 ip 70.123.182.155.",
    3: "Mrs. Maria Lopez met Mr. Smith; госпожа Иванова знает господин Петров.",
    4: None,
    5: "",
    6: "nothing private here, version 2.0, costs 12 and 2024",
    7: "Again 4111-1111-1111-1111 at 70.123.182.155!!\n\nTwo  spaces, ünïcode.",
}


def run(spark, rows=None, **kw):
    docs = spark.createDataFrame([(i, t) for i, t in (rows or TEXTS).items()], "doc_id long, text string")
    return {r.doc_id: r for r in pii.surrogated(docs, **kw).collect()}


def luhn(text):
    d = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def test_replacements(spark):
    out = run(spark)
    for i, t in TEXTS.items():
        if t is None:
            assert out[i].text is None and out[i].entities == []
    for secret in ("555-2485", "mail8", "bosbt", "4111", "4041894974608795", "70.123", "Lopez", "Maria", "Smith", "Иванова", "Петров"):
        assert not any(secret.lower() in (r.text or "").lower() for r in out.values()), secret
    assert out[5].text == "" and out[6].text == TEXTS[6] and out[6].entities == []
    assert [e.kind for e in out[1].entities] == ["phone", "phone", "email", "email"]
    assert [e.kind for e in out[3].entities] == ["name"] * 4
    # format, script and case stay
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}; Mail [A-Z][a-z]{4}\.\d\d@[a-z]+\.example, [a-z]{5}\.\d\d@[a-z]+\.example\.", out[1].text)
    assert re.match(r"Mrs\. \w+ \w+ met Mr\. \w+; госпожа [А-Я][а-я]+ знает господин [А-Я][а-я]+\.", out[3].text)
    assert out[3].text.split()[1] in pii.GIVEN["latin", "f"]
    assert out[7].text.endswith("!!\n\nTwo  spaces, ünïcode.")


def test_numbers_in_groups_of_two(spark):
    out = run(spark, {1: "ring +47 22 85 50 50 now", 2: "ring +32 16 32 10 22 now", 3: "ring +33 12 34 56 78 now", 4: "1 + 1 is 2"})
    assert all([e.kind for e in out[k].entities] == ["phone"] for k in (1, 2, 3)) and out[4].entities == []
    assert not any(x in out[k].text for k, x in ((1, "22 85 50"), (2, "16 32 10"), (3, "12 34 56")))


def test_every_match_holds_a_hint(spark):
    one = ["a@b.example.com", "é@x.co", "1.2.3.4", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1", "123-45-6789", "(12) 345 6789", "123 456 7890", "+1 (22) 345-6789", "+1 22 33", "+123-45-67", "+47 22 85 50 50", "+12345", "+1.22.33"]
    titles = ["Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Господин", "Госпожа", "господин", "госпожа"]
    one += [f"{t}{dot} {n}" for t in titles for dot in ("", ".") for n in ("Ab", "Яб")]
    row = spark.createDataFrame([(x,) for x in one], "t string").select("t", F.col("t").rlike(pii.ANY).alias("found"), F.col("t").rlike(pii.HINT).alias("hint"))
    assert all(r.found and r.hint for r in row.collect())


def test_coreference_and_distinctness(spark):
    out = run(spark)
    digits = lambda s: re.sub(r"\D", "", s)
    a, b = (e.surrogate for e in out[1].entities[:2])
    assert digits(a)[-10:] == digits(b)
    assert out[1].entities[2].surrogate.lower() == out[1].entities[3].surrogate
    assert digits(out[2].entities[0].surrogate) == digits(out[7].entities[0].surrogate)
    assert out[2].entities[2].surrogate == out[7].entities[1].surrogate
    assert luhn(out[2].entities[0].surrogate) and out[2].entities[0].surrogate[0] == "4"
    assert len({e.surrogate for r in out.values() for e in r.entities}) >= 9
    assert run(spark)[2].text == out[2].text and run(spark, key="other")[2].text != out[2].text


def test_collisions_draw_again_until_none_is_left(spark):
    """More entities than their format has numbers: they grow."""
    pairs = spark.createDataFrame([("phone", f"{n:02d}") for n in range(40)] + [("ssn", str(n)) for n in range(9)] + [("name", f"m a{n}") for n in range(12)], "kind string, value string")
    both = pairs.join(pii.redrawn(pairs), ["kind", "value"], "left").na.fill(0, ["attempt"])
    rows = both.select("kind", "value", "attempt", pii.surrogate(F.col("kind"), F.col("value"), F.col("attempt")).alias("s")).collect()
    assert len({(r.kind, r.s) for r in rows}) == 61 and not {(r.kind, r.s) for r in rows} & {(r.kind, r.value) for r in rows}
    assert {len(r.s) for r in rows if r.kind == "ssn"} >= {1, 2} or max(r.attempt for r in rows if r.kind == "ssn") < pii.GROW
    assert {(r.kind, r.value): (r.attempt, r.s) for r in rows} == {k: (n, brute_surrogate(*k, n)) for k, n in brute_attempts({(r.kind, r.value) for r in rows}).items()}


def brute_draw(seed, at, of):
    return int(hashlib.sha256(f"{seed}|{at}".encode()).hexdigest()[:12], 16) % of


def brute_surrogate(kind, value, attempt, key=pii.KEY):
    seed, more = f"{key}|{kind}|{value}|{attempt}", attempt // pii.GROW
    digit = "".join(str(1 + brute_draw(seed, 1, 9) if i == 1 else brute_draw(seed, i, 10)) for i in range(1, max(1, len(value) + more) + 1))
    if kind == "card":
        body = value[0] + digit[1 : len(value) + more - 1]
        return next(body + c for c in "0123456789" if luhn(body + c)) if luhn(value) else body + str(brute_draw(seed, 99, 10))
    if kind == "email":
        out = ""
        for i, c in enumerate(value.split("@")[0]):
            if regex.match(r"\p{IsCyrillic}", c):
                out += "абвгдежиклмнопрст"[brute_draw(seed, i, 17)]
            elif regex.match(r"\p{L}", c):
                out += "abcdefghijklmnopqrstuvwxyz"[brute_draw(seed, i, 26)]
            else:
                out += str(brute_draw(seed, i, 10)) if regex.match(r"\p{N}", c) else c
        return out + "@" + "".join("abcdefghijklmnopqrstuvwxyz"[brute_draw(seed, i, 26)] for i in range(100, 108)) + ".example"
    if kind == "ip":
        return ".".join(str(brute_draw(seed, k, 256) if k else brute_draw(seed, 0, 223) + 1) for k in range(4 + more))
    if kind == "name":
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", value) else "latin"
        last = "".join(pii.SYLLABLES[script][brute_draw(seed, i, 16)] for i in range(1, 5 + attempt)).title()
        return f"{pii.GIVEN[script, value[0]][brute_draw(seed, 0, 16)]} {last}" if " " in value[2:] else last
    return digit


def brute_attempts(entities):
    """Attempt of each entity once nothing collides, in rounds over all of them."""
    at = dict.fromkeys(entities, 0)
    while True:
        own = {k: brute_surrogate(*k, n) for k, n in at.items()}
        first = {}
        for k, n in at.items():
            first[k[0], own[k]] = min(first.get((k[0], own[k]), (n, k[1])), (n, k[1]))
        moved = [k for k in at if (k[0], own[k]) in entities or first[k[0], own[k]][1] != k[1]]
        if not moved:
            return at
        for k in moved:
            at[k] += 1


def brute_found(text):
    out = []
    for m in regex.finditer(pii.ANY, text or "") if regex.search(pii.HINT, text or "") else ():
        kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m[0]) or k == "phone" and not any(regex.fullmatch(q, m[0]) for q in pii.PATTERNS.values()))
        digits = re.sub(r"\D", "", m[0])
        if kind == "phone" and (m[0].startswith("+1") and len(digits) == 11 or m[0][0] != "+" and len(digits) > 10):
            digits = digits[-10:]
        name = ("f " if regex.match(pii.FEMALE, m[0]) else "m ") + regex.sub(pii.TITLE, "", m[0]).lower()
        out.append((m.start(), m.end(), m[0], kind, {"email": m[0].lower(), "ip": m[0], "name": name}.get(kind, digits)))
    return out


def brute_poured(kind, m, canon):
    if kind == "ip":
        return canon
    if kind == "name":
        return regex.match(pii.TITLE, m)[0] + canon
    if kind == "email":
        n = len(m.split("@")[0])
        return "".join(c.upper() if regex.match(r"\p{Lu}", x) else c for x, c in zip(m[:n], canon)) + canon[n:]
    total = len(re.sub(r"\D", "", m))
    out, at = "", -max(total - len(canon), 0)
    for c in m:
        if c.isdigit():
            c, at = canon[at] if at >= 0 else c, at + 1
        out += c
    return out + canon[total:]


def test_query_against_brute_force(spark, sf):
    from tessera.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {i: brute_found(t) for i, t in texts.items()}
    at = brute_attempts({(x[3], x[4]) for f in found.values() for x in f})
    for r in queries.op5_pii(spark, sf).collect():
        want, end = "", 0
        for a, b, m, kind, value in found[r.doc_id]:
            want += texts[r.doc_id][end:a] + brute_poured(kind, m, brute_surrogate(kind, value, at[kind, value]))
            end = b
        assert r.text == want + texts[r.doc_id][end:], r.doc_id
        assert r.kinds == ",".join(x[3] for x in found[r.doc_id]) and r.n_entities == len(found[r.doc_id])
    assert sum(map(len, found.values())) > 20


def test_prefixes_are_part_of_numbers(spark):
    out = run(spark, {1: "a +44 20 7123 4567 b", 2: "a +49 20 7123 4567 b", 3: "a +1 988 555 2485 b", 4: "a 988-555-2485 b"})
    digits = {k: re.sub(r"\D", "", r.text) for k, r in out.items()}
    assert digits[1][-10:] != digits[2][-10:] and digits[3] == "1" + digits[4]


def test_more_names_than_short_surnames(spark):
    people = spark.range(70_000).select(F.lit("name").alias("kind"), F.concat(F.lit("m x"), F.col("id")).alias("value"))
    both = people.join(pii.redrawn(people), ["kind", "value"], "left").na.fill(0, ["attempt"])
    assert both.select(pii.surrogate(F.col("kind"), F.col("value"), F.col("attempt")).alias("s")).distinct().count() == 70_000


def test_redrawn_entities_reach_the_texts(spark):
    rows = {k: f"call 555-{k:04d} now" for k in range(300)}
    out = run(spark, rows)
    assert len({r.text for r in out.values()}) == 300


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, TEXTS[1], "a", 1), (1, TEXTS[1], "a", 1), (None, "x " * 50000 + TEXTS[2], "b", 2)], "doc_id long, text string, kind string, `entity.x y` int")
    out = pii.surrogated(docs)
    assert out.columns == [*docs.columns, "entities"] and out.count() == 3
    assert pii.surrogated(docs.limit(0)).count() == 0


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.surrogated(docs).collect():
        assert (r.text == before[r.doc_id]) == (not r.entities)
        assert not re.search(r"@mail\d", r.text)
