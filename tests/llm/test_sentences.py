import numpy as np
import pytest

from mnemora.llm import boundaries, sentences, transducer

CASES = [
    ("It worked! Dr. Velm et al. saw 3.14 at 5 p.m. The end. Not so.", ["It worked!", "Dr. Velm et al. saw 3.14 at 5 p.m.", "The end.", "Not so."]),
    ("See Fig. 3 and p. 58. Die 2. Stufe, z. B. hier usw. Danach.", ["See Fig. 3 and p. 58.", "Die 2. Stufe, z. B. hier usw.", "Danach."]),
    ("“Is it?” asked L. Velm. He said: “No.” Then “Yes.”", ["“Is it?” asked L. Velm.", "He said: “No.”", "Then “Yes.”"]),
    ("科林写道：“缓存替换了。”完成了。“是吗？”评审人问道。真的吗？！好……再来。", ["科林写道：“缓存替换了。”", "完成了。", "“是吗？”评审人问道。", "真的吗？！", "好……再来。"]),
    ("「そうか？」と尋ねた。以上です。", ["「そうか？」と尋ねた。", "以上です。"]),
    ("หน้าแนวคิด 8.01 เท่านั้น ระบบค้นหา FTS5 อ่าน", ["หน้าแนวคิด 8.01 เท่านั้น", "ระบบค้นหา FTS5 อ่าน"]),
    ("قال د. كورين. هل؟ نعم.", ["قال د. كورين.", "هل؟", "نعم."]),
    ("डॉ. कोरिन ने कहा। क्या? हाँ।", ["डॉ. कोरिन ने कहा।", "क्या?", "हाँ।"]),
    ("Словарь и т. д. Видно. В 2024 г. граф.", ["Словарь и т. д.", "Видно.", "В 2024 г. граф."]),
    ("Joined.Here and v2.x.md kept. U.S.-style stays.", ["Joined.", "Here and v2.x.md kept.", "U.S.-style stays."]),
    ("« Le cache ! » a noté M. V. Quelle surprise ! Oui", ["« Le cache ! » a noté M. V. Quelle surprise !", "Oui"]),
    ("---\nt: x.\n---\n# A. B?\n\n- [ ] One. Two.\n1) three\n\n> Quo. Rex.\n\n| a. | b |\n\n```\nx. y.\n```\n***\nUser: Hi. Yo.\nAssistant: Ok", ["A. B?", "One.", "Two.", "three", "Quo.", "Rex.", "User: Hi.", "Yo.", "Assistant: Ok"]),
    ("A line\nthat wraps\n62. times. Then.\r\n\r\n　Indented one.\n　Two", ["A line\nthat wraps\n62. times.", "Then.", "Indented one.", "Two"]),
]


def units(text):
    _, a, b = sentences.split([text])
    return [text[x:y] for x, y in zip(a, b)]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_units(text, want):
    assert units(text) == want


def test_null_blank_and_open_texts():
    assert sentences.split([None, "", " \n\t　", "```\nnever closed. no", "---\nfront: x\nmore"]) == ([], [], [])


def test_texts_dont_disturb_each_other(spark):
    rows = [(i, t, 1) for i, (t, _) in enumerate(CASES)] + [(90, None, 1), (91, "```\nopen", 1), (0, CASES[0][0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_pos int")
    got = {}
    for r in sentences.sentences(df).distinct().collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for i, (t, want) in enumerate(CASES):
        assert [t[a:b] for a, b in sorted(got[i])] == want
    assert set(got) == set(range(len(CASES)))
    assert sentences.sentences(df.limit(0)).count() == 0


def test_long_documents_equal_their_parts():
    text = "\n\n".join(f"Line {i} is one. It has two?" for i in range(3000)) + "\n\n~~~\n" + "code. \n" * 4000 + "~~~\n\nEnd."
    assert len(units(text)) == 6001 and units(text)[-1] == "End."


def test_composed_functions_equal_a_plain_run():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        table = rng.integers(0, 5, (7, 5)).astype(np.uint8)
        symbols = rng.integers(0, 7, n)
        state, want = 2, []
        for s in symbols:
            want.append(state)
            state = table[s, state]
        assert transducer.states_before(table, symbols, 2).tolist() == want


def test_one_long_line_costs_no_more_than_its_length():
    line = 'Dr. Velm saw `x` and said: “No.” Then "yes" (3.14) at 5 p.m. The end! '
    few, many = units(line * 3), units(line * 30_000)
    assert len(many) == len(few) * 10_000 and many[: len(few) - 1] == few[:-1]
    assert len(units("a) . " * 200_000)) == 1


def test_decisions_are_compiled_once():
    table = boundaries.decisions()
    assert table is boundaries.decisions() and set(np.unique(table)) <= {boundaries.ENDS, boundaries.ENDS_AFTER_COLON, boundaries.NONE}
    lex = boundaries.lexicon()
    for word in ("Dr", "p.ex", "т.д"):
        state = np.array([1])
        for c in reversed(word):
            state = lex.step(state, np.array([ord(c)]))
        assert lex.flags[state[0]]
    assert lex.step(np.array([1]), np.array([ord("☃")]))[0] == 0
