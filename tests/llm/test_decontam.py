"""Copies that template windows alone cannot find."""

import pytest

from lectern.llm import decontam


def found(spark, item, text):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = spark.createDataFrame([(1, text), (2, "Something else that has nothing in common with it at all.")], "doc_id long, text string")
    return [(r.doc_id, r.verdict, r.matched_tokens, r.item_tokens) for r in decontam.contaminated(table, bench).collect()]


@pytest.mark.parametrize("item, tokens", [
    ("What is 12 + 7 + 19 + 3 + 45 + 6 + 88 + 2 + 17 + 31?", 12), ("3 km 4 kg 5 m 6 s", 8), ("Name two prime numbers", 4), ("Antidisestablishmentarianism", 1),
    ("水の沸点は何度ですか", 10), ("中国的首都是哪个城市？请回答。", 15), ("เมืองหลวงของไทยคือเมืองใด", 25),
])
def test_whole_items_of_any_kind(spark, item, tokens):
    assert found(spark, item, f"前文前文 Before. {item} After.") == [(1, "verbatim", tokens, tokens)]
    if ord(item[0]) > 0x2000:  # without blanks around it
        assert found(spark, item, f"前文。{item}後文") == [(1, "verbatim", tokens, tokens)]


def test_few_characters_in_common_are_no_copy(spark):
    item = "中国的首都是哪个城市请回答这个问题并且说明你的理由以及它的历史和地理位置还有人口数量与面积大小"
    assert found(spark, item, "他问中国的首都是哪个城市请回答这个然后走了") == []


@pytest.mark.parametrize("item, tokens", [
    ("Which river did Ann, Bob, Tom and Eve cross between Paris, Lyon, Nice and Metz?", 15),
    ("Der alte Mann ging am Morgen mit seinem Hund durch den dunklen Wald zum Haus der Tante und brachte ihr Brot und Wein", 23),
])
def test_copies_in_other_case(spark, item, tokens):
    for text in (item, item.lower(), item.upper()):
        assert found(spark, item, f"Before. {text} After.") == [(1, "verbatim", tokens, tokens)]
        assert found(spark, text, f"Before. {item} After.") == [(1, "verbatim", tokens, tokens)]


def test_values_of_other_token_counts(spark):
    item = "Every morning Ann buys 3 kg of flour and 12 eggs before she walks to Paris along the old road"
    copy = item.replace("Ann", "Mary Lou").replace("12", "twenty five").replace("Paris", "New York")
    for text in (copy, copy.replace("twenty five", "twenty-five")):
        assert found(spark, item, f"Before. {text} after.") == [(1, "reparameterised", 20, 20)]
        assert found(spark, text, f"Before. {item} after.") == [(1, "reparameterised", 20, 20)]
    twice = "Every morning Ann Lee buys flour and eggs before she walks with Ann Lee along the old road to the market"
    assert found(spark, twice, twice.replace("Ann Lee", "Bo")) == [(1, "reparameterised", 19, 19)]
    assert found(spark, twice, twice.replace("Ann Lee", "Lee Ann", 1).replace("Ann Lee", "Tom")) == []  # one value goes to two


@pytest.mark.parametrize("item, copy", [
    ("Tom bought three red apples and four green pears at the corner market.", "Eve bought nine red apples and two green pears at the corner market."),
    ("Tom has 5 boxes of red chalk. Ann takes 2 boxes of them home. Tom then buys 7 more boxes there. How many boxes are left for Tom now?",
     "Mary Lou has 15 boxes of red chalk. Bob takes 3 boxes of them home. Mary Lou then buys 9 more boxes there. How many boxes are left for Mary Lou now?"),
])
def test_names_that_open_sentences(spark, item, copy):
    for a, b in ((item, copy), (copy, item)):
        assert [x[:2] for x in found(spark, a, f"before. {b} after.")] == [(1, "reparameterised")]


def _tokens(text):
    """[(word, type, opens, continues)] of an ASCII text, after the rules as the module states them."""
    import re

    out, last = [], None
    for m in re.finditer(r"[A-Za-z]+|\d+(?:[.,]\d+)*", text or ""):
        w = m[0]
        gap = text[last:m.start()] if last is not None else None
        opens = gap is None or any(c in '.!?\n:;"()[]{}|' for c in gap)
        low, kind = w.lower(), 0
        if w[0].isdigit() or low in decontam.NUMBER_WORDS:
            kind = decontam.NUMBER
        capital = kind == 0 and w[0].isalpha() and len(w) > 1 and sum(c.isupper() for c in w) == 1 and any(c.isupper() for c in w[:2])
        if capital and not opens:
            kind = decontam.NAME
        if kind == 0 and out and out[-1]["kind"] == decontam.NUMBER and low in decontam.UNITS:
            kind = decontam.UNIT
        out.append({"w": low, "kind": kind, "opened": decontam.NAME if capital and opens else kind,
                    "beside": gap is not None and all(c in " \t\r\n-" for c in gap), "letters": w[0].isalpha()})
        last = m.end()
    return out


def _form(text, form):
    kind = "opened" if form == decontam.OPENED else "kind"
    tokens = []
    for t in _tokens(text):
        more = tokens and t["beside"] and t[kind] == tokens[-1][1] and (t[kind] == decontam.NAME or (t[kind] == decontam.NUMBER and t["letters"]))
        if more and form in (decontam.COLLAPSED, decontam.OPENED):
            tokens[-1] = (f"{tokens[-1][0]} {t['w']}", t[kind])
        else:
            tokens.append((t["w"], t[kind]))
    return tokens


def _brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            for form in (decontam.TEMPLATE, decontam.PLAIN, decontam.COLLAPSED, decontam.OPENED):
                a, b = _form(item, form), _form(text, form)
                size = min(len(a), decontam.WINDOW)
                if not size or (size < decontam.SHORT and form != decontam.PLAIN):
                    continue
                key = lambda t: (t[0], 0) if form == decontam.PLAIN or t[1] == 0 else ("", t[1])
                shifts = {}
                for x in range(len(a) - size + 1):
                    wx = a[x : x + size]
                    if form != decontam.PLAIN and sum(t[1] == 0 for t in wx) < min(decontam.LITERALS, size - 1):
                        continue
                    for y in range(len(b) - size + 1):
                        if [key(t) for t in wx] == [key(t) for t in b[y : y + size]]:
                            shifts.setdefault(y - x, set()).add(y)
                for s, places in shifts.items():
                    covered = {y + k for y in places for k in range(size)}
                    slots = set() if form == decontam.PLAIN else {(a[y - s][0], b[y][0]) for y in covered if a[y - s][1]}
                    if len(slots) != len({p for p, _ in slots}) or len(covered) < min(decontam.ENOUGH, len(a)):
                        continue
                    best = (len(covered), -sum(p != q for p, q in slots), len(a))
                    out[d, i] = max(out.get((d, i), best), best)
    return {(d, i, n, total, -kept) for (d, i), (n, kept, total) in out.items()}


def test_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    words = "he the cat sat on old mat and then went to buy some more fresh food at noon for all of us".split()
    names = ["Ann", "Bob", "Eve", "New York", "Mary Lou", "Paris"]
    numbers = ["3", "12", "twenty five", "1,000", "seven", "4.5"]

    def sentence(n):
        out = [rng.choice([w, w, w, rng.choice(names), rng.choice(numbers) + rng.choice([" kg", "", " km"])]) for w in rng.choices(words, k=n)]
        return (out[0].capitalize() if rng.random() < 0.5 else out[0]) + " " + " ".join(out[1:]) + rng.choice([".", "?", ",", ""])

    items = [(k, " ".join(sentence(rng.randint(2, 14)) for _ in range(rng.randint(1, 3)))) for k in range(12)] + [(50, "old mat"), (51, ""), (52, None)]

    def changed(text):
        for _ in range(rng.randint(0, 4)):
            text = text.replace(rng.choice(names + numbers + words[:4]), rng.choice(names + numbers), rng.choice([1, -1]))
        return rng.choice([text, text.lower(), text.upper(), text])

    docs = [(k, f"{sentence(5)} {changed(rng.choice(items[:12])[1])} {sentence(6)}") for k in range(60)] + [(100, None), (101, "")]
    docs += [docs[0]]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, hash int, id int")
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, at int, vals int").repartition(3)
    got = {(r.doc_id, r.item_id, r.matched_tokens, r.item_tokens, r.changed_slots) for r in decontam.contaminated(table, bench).collect()}
    want = _brute(docs, items)
    assert len(want) > 30 and got == want
