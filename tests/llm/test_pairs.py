import random

import pytest

from mnemora.llm import pairs

QA = {
    "en": [("Where did I leave {o}?", "You left {o} {p}.", "A later session confirms this, so the older value no longer holds.", ["the blue folder", "the spare key", "box no. 12", "the small drill"], ["on the top shelf", "under the stairs", "in the tool shed", "behind the printer"], ["I have no record of that.", "Sorry, I can't help with that.", "The notes don't say.", "No answer can be given from these memories."])],
    "de": [("Wo habe ich {o} gelassen?", "Du hast {o} {p} gelassen.", "Eine spätere Sitzung bestätigt das, also gilt der ältere Wert nicht mehr.", ["die blaue Mappe", "den Schlüssel", "die Kiste Nr. 12", "den kleinen Bohrer"], ["ganz oben im Regal", "unter der Treppe", "im Schuppen", "hinter dem Drucker"], ["Dazu steht nichts in den Notizen.", "Leider kann ich dabei nicht helfen.", "Das wurde nie notiert.", "Dazu liegen mir keine Angaben vor."])],
}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(0)
    out = []
    for n in range(600):
        q, a, more, objects, places, refusals = QA["en" if n % 3 else "de"][0]
        o, p = rng.choice(objects), rng.choice(places)
        answer = a.format(o=o, p=p) + (f" {more}" if n % 2 else "")
        if n % 10 == 0:
            out.append((f"q{n}_abs", q.format(o=o), "Not mentioned.", True, rng.choice(refusals), "PASS"))
        elif n % 10 == 1:
            out.append((f"q{n}", q.format(o=o), p, False, p, "PASS"))
        else:
            out.append((f"q{n}", q.format(o=o), p, None if n % 7 == 0 else False, answer, "PASS"))
    return out


@pytest.fixture(scope="module")
def labelled():
    return [(lang, (q.format(o=o) + " " + a.format(o=o, p=p) + " " + m)) for lang, rows in QA.items() for q, a, m, os, ps, _ in rows for o in os for p in ps]


BAD = [
    ("b1", "Where did I leave the spare key?", "on the top shelf", False, None, ["empty"]),
    ("b2", "Where did I leave the spare key?", "on the top shelf", False, "**Answer:** ", ["empty"]),
    ("b3", "Where did I leave the spare key?", "on the top shelf", False, "n/a", ["empty"]),
    ("b4", "Where did I leave the spare key?", "on the top shelf", False, "You left the spare key on the top shelf. A later session confirms this, so the old", ["truncated"]),
    ("b5", "Where did I leave the spare key?", "on the top shelf", False, "You left the spare key on the", ["truncated"]),
    ("b6", "Where did I leave the spare key?", "on the top shelf", False, "I have no record of that.", ["refusal"]),
    ("b7", "Where did I leave the spare key?", "on the top shelf", False, "The user wants to know: WHERE DID I LEAVE THE SPARE KEY", ["copy"]),
    ("b8", "Where did I leave the spare key?", "on the top shelf", False, "Question: Where did I leave the spare key?\nAnswer:", ["copy"]),
    ("b9", "Where did I leave the spare key?", "on the top shelf", False, "Du hast den Schlüssel ganz oben im Regal gelassen.", ["language"]),
    ("g1", "Where did I leave the spare key?", "on the top shelf", False, "You left the spare key on the top shelf", []),
    ("g2_abs", "Where did I leave the spare key?", "No such event.", None, "I have no record of that.", []),
    ("g3", "Where did I leave the spare key?", "on the top shelf", False, "Where did I leave the spare key? You left the spare key on the top shelf.", []),
    ("g4", "Where did I leave the spare key?", "on the top shelf", False, "You left the spare key in the tool shed.", []),
    ("g5", "How many are left?", "None", False, "None", []),
]


def test_each_defect_and_what_is_none(rows, labelled):
    models = pairs.fit(rows, labelled)
    for *row, want in BAD:
        assert pairs.defects(tuple(row), *models) == want, row
    good = [r for r in rows if pairs.defects(r[:5], *models)]
    assert len(good) <= 6


def test_the_operator_counts_repeats_once(spark, rows, labelled):
    bad = [(*b[:5], "FAIL") for b in BAD]
    schema = "question_id string, question string, ground_truth string, is_abstention boolean, generated_answer string, judgment string"
    df = spark.createDataFrame(rows + bad + bad + [(None, "q", "t", None, None, None), ("n1", None, None, None, "x", None)], schema)
    texts = spark.createDataFrame(labelled + [(None, "x"), ("xx", None)], "lang string, text string")
    got = sorted((r.question_id, r.defect) for r in pairs.broken(df, texts).where("question_id like 'b%'").collect())
    assert got == sorted((b[0], b[5][0]) for b in BAD if b[5])
    assert pairs.broken(df.limit(0), texts.limit(0)).count() == 0


def test_models_count_every_row(spark, rows, labelled):
    import numpy as np

    schema = "question_id string, question string, ground_truth string, is_abstention boolean, generated_answer string, judgment string"
    texts = [x for x in labelled if len(x[1]) > 40] * 5  # more than 200 a language
    got = pairs.fitted(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(texts, "lang string, text string"))
    want = pairs.fit(list(dict.fromkeys(r[:5] for r in rows)), texts)
    a, b = got[0].model, want[0].model
    assert a.labels == b.labels and np.array_equal(a.known, b.known) and np.allclose(a.logs, b.logs) and got[0].asking == want[0].asking
    answers = [r[4] for r in rows] + [x[4] for x in BAD if x[4]]
    assert got[2].model.logs == want[2].model.logs and got[2].model.texts == want[2].model.texts
    known = [r[4] for r in rows]
    assert got[1].chances(known) == want[1].chances(known) and len(answers) > len(known)
