import random
import time

import pytest
from conftest_llm import ODD

from stratalake.llm import decontaminate, licenses, pii

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(3000)]


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def best(doc, item):
    """The most equal words, place by place, in a window of the item over all alignments."""
    window, top = min(len(item), decontaminate.WINDOW), 0
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        top = max([top, *(sum(same[i : i + window]) for i in range(len(item) - window + 1))])
    return top, window


def test_passages_with_replaced_words(spark, documents):
    tests = [prose(n) for n in (5, 6, 7, 12, 20, 21, 40, 90)] + [prose(3)]
    docs = []
    for k in range(60):
        item = list(tests[k % len(tests)])
        for _ in range(rng.randrange(0, max(1, len(item) // 4))):
            item[rng.randrange(len(item))] = rng.choice(WORDS)
        if k % 4 == 0:
            item.insert(len(item) // 2, "extra")
        docs.append(prose(rng.randrange(30)) + item + prose(rng.randrange(30)))
    docs += [prose(80) for _ in range(40)]
    rows = [(i, ", ".join(d)) for i, d in enumerate(docs)]
    got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in decontaminate.matches(documents(rows, extra=True), items(spark, [(i, " ".join(t)) for i, t in enumerate(tests)])).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(tests):
            m, w = best(d, t)
            if m * 5 >= w * 4:
                want[i, j] = (m, w)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    # Two seeds see all but a few of the passages at the limit, and every one with at most one word replaced in ten.
    assert all(k in got for k, (m, w) in want.items() if m * 10 >= w * 9 and w >= 12 or m == w)
    assert len(got) >= 0.95 * len(want)


def test_short_items_with_any_words_replaced(spark, documents):
    tests = {n: [f"w{n}x{i}" for i in range(n)] for n in range(5, 11)}
    rows = []
    for n, item in tests.items():
        for i in range(n):
            for j in range(n) if n == 10 else [i]:
                rows.append((1000 * n + len(rows), " ".join(["before", *("other" if k in (i, j) else w for k, w in enumerate(item)), "after"])))
        rows += [(1000 * n + 500, " ".join(item[1:])), (1000 * n + 501, " ".join(item[:-1]))]
    found = decontaminate.matches(documents(rows), items(spark, [(n, " ".join(t)) for n, t in tests.items()])).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted((i, i // 1000) for i, _ in rows)


def test_items_of_one_to_four_words_stand_there_word_for_word(spark, documents):
    tests = [["one"], ["two", "words"], ["three", "words", "here"], ["four", "words", "stand", "here"], []]
    docs = [["a", *t, "b"] for t in tests] + [["one"], ["two", "other", "words"], ["three", "word", "here"], ["four", "words", "here", "stand"], ["two", "words"] * 3]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {(r.doc_id, r.item_id, r.matched, r.window) for r in decontaminate.matches(documents(rows), items(spark, [(j, " ".join(t)) for j, t in enumerate(tests)])).collect()}
    want = {(i, j, len(t), len(t)) for i, d in enumerate(docs) for j, t in enumerate(tests) if t and any(d[k : k + len(t)] == t for k in range(len(d)))}
    assert got == want and len(want) == 6


def test_odd_rows_and_empty_tables(spark, documents):
    text = " ".join(prose(30))
    odd = documents([*ODD, (20, text), (20, text), (None, text)], extra=True)
    found = decontaminate.matches(odd, items(spark, [(None, text), (1, text), (1, text), (2, None), (3, "one two")])).collect()
    assert sorted((r.doc_id or -1, r.item_id or -1, r.matched, r.doc_at) for r in found) == [(-1, -1, 20, 0), (-1, 1, 20, 0), (20, -1, 20, 0), (20, 1, 20, 0)]
    kept = decontaminate.decontaminate(odd, items(spark, [(1, text)]))
    assert kept.count() == len(ODD) and kept.columns == odd.columns
    assert decontaminate.decontaminate(odd, items(spark, [])).count() == len(ODD) + 3
    assert decontaminate.matches(documents([]), items(spark, [(1, text)])).count() == 0


def test_shuffled_and_broadcast_joins_agree(spark, documents, monkeypatch):
    text = " ".join(prose(30))
    docs, tests = documents([(1, "a " + text), (2, "b")]), items(spark, [(1, text)])
    small = decontaminate.matches(docs, tests).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert decontaminate.matches(docs, tests).collect() == small and len(small) == 1


def contained(text, form, n=5):
    import regex

    cut = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    t = grams(cut(form))
    return len(t & grams(cut(text))) / len(t) if t else 0.0


def test_licenses_against_every_template(spark, documents):
    forms = [(name, f) for name, fs in licenses.TEMPLATES.items() for f in fs]
    rows = []
    for k, (_, form) in enumerate(forms * 3):
        words = form.split()
        if k >= len(forms):
            words[rng.randrange(len(words))] = "changed"
        if k >= 2 * len(forms):
            words = words[: int(len(words) * 0.7)]
        rows.append((k, " ".join(prose(rng.randrange(40)) + words + prose(rng.randrange(40)))))
    rows += [(900 + i, " ".join(prose(60))) for i in range(20)] + [(950, "under the license we license this software under terms " * 30)]
    got = {(r.doc_id, r.license): round(r.containment, 9) for r in licenses.scan(documents(rows, extra=True)).collect()}
    want = {}
    for doc_id, text in rows:
        for name, form in forms:
            share = contained(text, form)
            if share >= 0.8:
                want[doc_id, name] = round(max(share, want.get((doc_id, name), 0.0)), 9)
    assert got == want and len(want) > len(forms)


def test_many_templates_are_joined_by_a_shuffle(spark, documents, monkeypatch):
    rows = [(1, "x " + next(iter(licenses.ALL.values()))[0]), (2, "All rights reserved."), (3, "nothing")]
    sent = sorted(map(tuple, licenses.scan(documents(rows)).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_CHARS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = licenses.scan(documents(rows))
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == sent and len(sent) >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_licenses_of_odd_rows(spark, documents):
    line = "Released under the MIT License."
    odd = documents([*ODD, (30, line), (30, line), (None, line)], extra=True)
    assert sorted((r.doc_id or -1, r.license) for r in licenses.scan(odd).collect()) == [(-1, "mit"), (30, "mit")]
    assert licenses.scan(documents([])).count() == 0
    assert licenses.scan(odd, {}).count() == 0
    with pytest.raises(ValueError):
        licenses.anchors([["to", "be", "or", "is", "it"]])


def test_short_notices(spark, documents):
    rows = [
        (1, "All rights reserved."), (2, " ".join(prose(30)) + ". All rights reserved.\n" + " ".join(prose(30))), (3, "# SPDX-License-Identifier: MIT"),
        (4, "SPDX-License-Identifier: Apache-2.0"), (5, "all rights are reserved, all rights"), (6, "reserved all rights"), (7, "SPDX-License-Identifier: CC-BY-NC-4.0"),
        (8, "SPDX-License-Identifier: Unlicense. All RIGHTS, reserved!"), (9, "the mit license identifier spdx"),
    ]
    got = sorted((r.doc_id, r.license, r.containment, r.shingles) for r in licenses.scan(documents(rows, extra=True)).collect())
    whole = [(1, "all-rights-reserved", 1), (2, "all-rights-reserved", 1), (3, "mit", 1), (4, "apache-2.0", 2), (7, "cc-by-nc-4.0", 4), (8, "all-rights-reserved", 1), (8, "unlicense", 1)]
    assert got == [(i, name, 1.0, n) for i, name, n in whole]
    own = licenses.scan(documents([(1, "Proprietary"), (2, "not ours"), (3, "no proprietary code")]), {"p": ["Proprietary."], "none": [""], "two": ["ours not"]})
    assert sorted((r.doc_id, r.license) for r in own.collect()) == [(1, "p"), (3, "p")]


@pytest.mark.parametrize("find", ["decontaminate", "licenses"])
def test_no_python_in_the_plans(spark, documents, find):
    df = decontaminate.matches(documents([(1, "a")]), items(spark, [(1, "b")])) if find == "decontaminate" else licenses.scan(documents([(1, "a")]))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


FEISTEL = pii.Feistel(b"test")


def test_permutations_are_one_to_one():
    for n in (1, 2, 10, 1000, 4096):
        new = [FEISTEL.permute(i, n, "t") for i in range(n)]
        assert sorted(new) == list(range(n))
        assert [FEISTEL.permute(i, n, "t", back=True) for i in new] == list(range(n))
    big = 10**40
    assert FEISTEL.permute(FEISTEL.permute(12345, big, "x"), big, "x", back=True) == 12345


VALUES = {
    "card": ["4207051279108084", "4111-1111-1111-1111", "378282246310005"], "phone": ["+1 (375) 555-4393", "212-555-0123", "(212) 555-0123"],
    "ip": ["49.37.233.206", "8.8.8.8"], "email": ["fakol.33@mail7.example.com", "A.b+c@x.org"], "iso": ["1984-02-29"], "slash": ["31/12/1999", "12/31/1999", "01/02/2003"],
    "dot": ["05.06.2001"], "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"], "secret": ["e3b3ed3cc8548923d6"], "world": ["+49 30 1234567"],
}


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_format_and_come_back(kind):
    for value in VALUES[kind]:
        text = f"Before password={value}, after." if kind == "secret" else f"Before {value}, after {value}."
        new, found = pii.pseudonymise(text, FEISTEL)
        assert found == [kind] * text.count(value) and value not in new
        assert kind == "ip" or len(new) == len(text)
        assert pii.pseudonymise(new, FEISTEL) != (new, []) and pii.pseudonymise(new, FEISTEL, back=True)[0] == text
        assert pii.pseudonymise(text, pii.Feistel(b"other"))[0] != new


@pytest.mark.parametrize("value", ["a1B2c3" * 30_000, "0a1b2c3d" * 30_000, "x" * 1023 + "7", "Zz9" * 171])
def test_long_secrets_are_permuted_in_pieces(value):
    """Work that grows with the length: all of it is changed, keeps its format, comes back, and depends on what stands before."""
    f = pii.Feistel(b"key")
    start = time.perf_counter()
    new, kinds = pii.pseudonymise(f"token={value} end", f)
    assert time.perf_counter() - start < 5 and kinds == ["secret"]
    shown = new.removeprefix("token=").removesuffix(" end")
    assert [pii._alphabet(c) for c in shown] == [pii._alphabet(c) for c in value] or set(value) <= set("0123456789abcdef")
    assert len(shown) == len(value) and all(shown[i : i + 512] != value[i : i + 512] for i in range(0, len(value), 512) if len(value) - i > 20)
    assert pii.pseudonymise(new, f, back=True)[0] == f"token={value} end"
    if len(value) > 1500:
        pieces = [shown[i : i + 480] for i in range(0, len(value) - 512, 512)]
        assert len(set(pieces)) == len(pieces)


def test_values_that_fail_validation_stay():
    text = "4207051279108085 1984-02-30 999.1.1.1 000-12-3456 DE00370400440532013000 1.2.3 v10.0.19041.1.2 2024 3.14 call 115-155-0123 password: none at all x@y"
    assert pii.pseudonymise(text, FEISTEL) == (text, [])


@pytest.mark.parametrize("form", ["+1 ({}) {}-{}", "({}) {}-{}", "1 ({}) {} {}", "+1 {}.{}.{}", "+1-{}-{}-{}"])
def test_marked_phones_outside_the_north_american_range(form):
    numbers = [("017", "555", "7713"), ("132", "555", "1352"), ("212", "155", "0123"), ("999", "199", "9999"), ("200", "000", "0000"), ("199", "999", "9999"), ("000", "000", "0000")]
    seen = set()
    for number in numbers:
        value = form.format(*number)
        new, found = pii.pseudonymise(f"call {value}, now", FEISTEL)
        assert found == ["phone"] and value not in new and len(new) == len(value) + 10
        own = "".join(c for c in new if c.isdigit())[-10:]
        assert own[0] in "01" or own[3] in "01"
        assert pii.pseudonymise(new, FEISTEL, back=True)[0] == f"call {value}, now"
        seen.add(own)
    assert len(seen) == len(numbers)


SWALLOWED = {
    "card 4111 1111 1111 1111 12/25": ("4111 1111 1111 1111", "card"), "card 4111 1111 1111 1111 123": ("4111 1111 1111 1111", "card"),
    "4111-1111-1111-1111-123, 4": ("4111-1111-1111-1111", "card"), "4111111111111111 123": ("4111111111111111", "card"), "amex 3782 822463 10005 1234": ("3782 822463 10005", "card"),
    "12 4111 1111 1111 1111": ("4111 1111 1111 1111", "card"), "no 000 000 4111 1111 1111 1111": ("4111 1111 1111 1111", "card"), "on 2024-01-15T10:00:00Z": ("2024-01-15", "iso"),
    "1234 5678 2024-01-15 x": ("2024-01-15", "iso"), "BE68 5390 0754 7034 EUR": ("BE68 5390 0754 7034", "iban"), "+44 20 7946 0958 2024 x": ("+44 20 7946 0958", "world"),
    "password: michaeljones@example.com": ("michaeljones@example.com", "email"),
}


@pytest.mark.parametrize("text", SWALLOWED)
def test_values_within_a_failed_longer_match(text):
    value, kind = SWALLOWED[text]
    for key in (b"test", *(bytes([k]) for k in range(40))):  # under some keys a pseudonym makes the longer match right
        feistel = pii.Feistel(key)
        new, found = pii.pseudonymise(text, feistel)
        assert found == [kind] and value not in new and new.replace(new[text.index(value) :][: len(value)], value) == text
        assert pii.pseudonymise(new, feistel, back=True) == (text, [kind])


def test_a_card_has_one_pseudonym_whatever_follows():
    def card(tail):
        new, found = pii.pseudonymise(f"card 4111 1111 1111 1111{tail}", FEISTEL)
        assert found == ["card"]
        return new[5:24]

    right = [t for t in (f" {i:03d}" for i in range(1000)) if pii.luhn(f"4111111111111111{t[1:3]}") != int(t[3])]
    assert len(right) == 900 and {card(t) for t in right} == {card("")}


def test_every_run_of_groups_comes_back():
    draw = random.Random(5)
    for _ in range(3000):
        groups = ["".join(draw.choice("0123456789") for _ in range(draw.choice((1, 2, 3, 4, 4, 4, 5, 6)))) for _ in range(draw.randrange(3, 12))]
        text = "".join(g + draw.choice("  -") for g in groups)
        new, found = pii.pseudonymise(text, FEISTEL)
        assert pii.pseudonymise(new, FEISTEL, back=True) == (text, found)


def test_pseudonyms_of_documents(spark, documents):
    rows = [*ODD, (40, "card 4207051279108084"), (41, "again 4207051279108084!"), (41, "again 4207051279108084!")]
    df = documents(rows, extra=True)
    got = pii.pseudonymise_documents(df, b"k")
    assert got.columns == [*df.columns, "pii_kinds"]
    texts = [r.text for r in got.where("doc_id in (40, 41)").collect()]
    assert len({t.split()[1].rstrip("!") for t in texts}) == 1 and "4207051279108084" not in texts[0]
    back = pii.pseudonymise_documents(got, b"k", back=True).drop("pii_kinds")
    key = lambda r: str(r)
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
    assert pii.pseudonymise_documents(documents([]), b"k").count() == 0
