from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import langid, pairs, refusals

SCHEMA = "memory_id bigint, user_prompt string, assistant_response string, omitted_before_chars bigint, defect string, ends string"
GOOD = [
    ("Why does the worker wait for the lock?", "The worker was waiting for the lock, which expires after 3 s. I moved the check into the loader and all tests pass."),
    ("Bitte schreib einen Test für die leere Liste und erkläre, warum das nicht geht.", "Der Fehler kam von einem zweiten Schreiber, der nicht auf die Sperre wartet. Ich habe den Test geschrieben."),
    ("Ajoute un test pour la liste vide, et dis-moi pourquoi il est appelé deux fois.", "Le test est dans le fichier. La cause se trouve dans le cache, qui est déjà rempli avec les valeurs."),
    ("Añade una prueba para la lista vacía y busca dónde empieza el error por favor.", "La causa está en la caché, que ya está llena con los valores. Moví la comprobación y pasan las pruebas."),
]


def find(spark, rows):
    df = spark.createDataFrame([(i, u, a, 0, "x", "y") for i, u, a in rows], SCHEMA)
    return {r.memory_id: r.defect for r in pairs.find_defects(df).collect()}


def base(n=12):
    return [(1000 + k * len(GOOD) + j, u, a) for k in range(n) for j, (u, a) in enumerate(GOOD)]


def test_each_defect(spark):
    q = GOOD[0][0]
    rows = [(1, q, None), (2, q, " ​\n"), (3, q, "..."), (4, q, "undefined"), (5, q, "[no output]"), (6, None, None), (7, "?!", "x"),
            (10, q, "I'm sorry, but I can't help with that request."), (11, q, "Lo siento, no puedo ayudar con esa petición."), (12, q, 'The line "Sorry, I can\'t help with that" is now printed only when it has failed.'), (13, q, "I won't touch the loader in this step, the fix is enough."),
            (20, q, q.lower()), (21, q, "You asked: " + q), (22, q, "> " + q + "\n\nThe worker was waiting for the lock, which expires after 3 s."), (23, q, "Why  does  the worker wait for the lock"),
            (30, q, GOOD[1][1]), (31, q + " Please answer in German.", GOOD[1][1]), (32, GOOD[3][0], GOOD[0][1]),
            (40, q, "The worker was waiting for the lock, which exp"), (41, q, "The remaining steps are:"), (42, q, "Here it is.\n\n```py\nx = 1\n"), (43, q, "Here it is.\n\n```py\nx = 1\n```"), (44, q, "1. The test is there.\n2. "), (45, q, "I moved the check into the loader and all tests pass"), (46, q, "| a | b |\n|---|---|\n| 1 | 2 |"), (47, q, "| a | b |\n|---|---|\n| 1 |")]
    got = find(spark, base() + rows)
    want = {1: "empty", 2: "empty", 3: "empty", 4: "empty", 5: "empty", 10: "refusal", 11: "refusal", 20: "copied", 21: "copied", 23: "copied", 30: "language", 32: "language",
            40: "truncated", 41: "truncated", 42: "truncated", 44: "truncated", 47: "truncated"}
    assert {k: v for k, v in got.items() if k < 1000} == want
    assert not [k for k in got if k >= 1000]


def test_repeats_nulls_and_empty(spark):
    got = find(spark, base() + [(1, GOOD[0][0], None), (1, GOOD[0][0], None), (None, GOOD[0][0], None), (2, "Why does the worker wait for the lock that is in the loader? " * 3_000, "The worker was waiting for the lock, which is in the loader. " * 3_000)])
    assert got == {1: "empty"}
    assert find(spark, []) == {}


@pytest.mark.parametrize("text,lang", [(a, k) for k, (_, a) in zip(("en", "de", "fr", "es"), GOOD)])
def test_language(text, lang):
    model = langid.fit([t for p in GOOD for t in p])
    assert langid.LANGUAGES[langid.log_posteriors(model, [text])[0].argmax()] == lang


def test_code_says_nothing_of_a_language():
    model = langid.fit([t for p in GOOD for t in p])
    x = langid.log_posteriors(model, [None, "", "```\nthe code is the code\n```", "fooBar(1) x/y.py 77"])
    assert (x.max(axis=1) == x.min(axis=1)).all()


def test_padding_and_length_hide_nothing():
    for pad in (" " * 60, "\n" * 60, "\u200b" * 60):
        assert pairs.is_empty("N/A" + pad) and pairs.is_empty(pad + "null" + pad) and not pairs.is_empty("null" + pad + "and so on")
        assert pairs.is_copied("Move the check", pad * 5 + "move the check" + pad * 5) and pairs.is_copied(pad * 9 + "Move the check", "move the check.")
    assert not pairs.is_copied("Move the check", "Moved the check and ran all tests")
    model = refusals.fit(refusals.background([a for _, a in GOOD] * 50))
    assert refusals.is_refusal(model, "I cannot help with this request. " * 200) and not refusals.is_refusal(model, "I cannot help with this request. " * 200 + "The loader is fixed now.")


def test_language_model_counts_all_rows(spark):
    rows = [(i, "the check is in the loader and it was there", "we have it now and that is how it was") for i in range(7000)] + [(7000, "Zqxwv ist nicht in der Liste und das ist wie es war", None)]
    df = spark.createDataFrame(rows, "memory_id bigint, user_prompt string, assistant_response string")
    want = langid.fit_pairs([(r[1], r[2]) for r in rows])
    assert abs(pairs.language_model(df) - want).max() < 0.01


@pytest.mark.parametrize("text,want", [
    ("I am afraid I cannot assist with this request.", True), ("That would go against my policy, and I have to decline.", True), ("Lo siento, pero no puedo ayudar con esa pregunta.", True), ("Leider darf ich diese Anfrage nicht beantworten.", True),
    ("Désolé, je ne peux pas répondre à cette demande.", True), ("I'm unable to provide an answer about src/a_b.py.", True), ("I'm sorry, but I can't help with that. Please ask someone on the import team instead.", True),
    ("I moved the check into the loader and all tests pass.", False), ('The line "Sorry, I can\'t help with that" is now printed only when it has failed.', False), ("I'm sorry, but I can't help with that. I moved the check into the loader, and the tests pass.", False),
    ("Please ask someone else.", False), ("", False), ("```", False)])
def test_refusals(text, want):
    model = refusals.fit(refusals.background([refusals.opening(a) for _, a in GOOD] * 200))
    assert refusals.is_refusal(model, text) is want


def test_ends_are_likelier_than_going_on():
    # the last five words tell most, then three, then one
    assert pairs.ends_here([(9, 10), (9, 100), (0, 1000)], 0.05) and not pairs.ends_here([(0, 10), (0, 100), (900, 1000)], 0.05)
    assert not pairs.ends_here([(0, 0), (0, 0), (0, 0)], 0.05) and pairs.ends_here([(0, 0), (90, 100), (0, 0)], 0.05) and not pairs.ends_here([(0, 0), (1, 1), (0, 50)], 0.05)


def test_answers_in_a_set_form_are_whole_though_the_form_goes_on_elsewhere(spark):
    q = "Which commit moved the check into the loader?"
    answers = [(i, q, f"commit {0xABC1230 + i:x}") for i in range(40)]
    within = [(100 + i, q, f"commit {0xBCD1230 + i:x} moved the check into the loader and all tests pass.") for i in range(30)]
    # broken in the middle of words that go on elsewhere, two at the same place
    broken = [(200 + i, q, f"{n} tests failed. The worker was waiting for the lo") for i, n in enumerate(("Three", "Four"))]
    assert find(spark, base() + answers + within + broken) == {200: "truncated", 201: "truncated"}


def counted(*texts):
    grams, ends = pairs.places_and_ends(list(texts), pairs._Tokens())
    places, ended = Counter(), Counter()
    for five, three, one, end in zip(*(x.tolist() for x in grams), ends.tolist()):
        for h in {five, three, one}:
            places[h] += 1
            ended[h] += end
    return places, ended


def test_counted_ends():
    places, ends = counted("it waits for the lock. it waits for the lock now\nit waits for the lock", None, "", " \n ")
    of = lambda words: (places[pairs.words_hash(words)], ends[pairs.words_hash(words)])
    assert of("it waits for the lock") == (2, 1) and of("for the lock") == (2, 1) and of("1 lock") == (2, 1) and of("1 now") == (1, 0) and of("^ it waits") == (3, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["it", "waits", "for", "the", "lock.", "lock", "src/a_b.py", "3.", "v2.", "now!", "?", "\n", "ABC", "fooBar()", "- x", "e28570c18c"]), max_size=40), max_size=3))
def test_counted_places_are_those_of_last_words(texts):
    texts = [" ".join(parts).replace(" \n ", "\n") for parts in texts]
    places, ends = counted(*texts)
    want, ended = Counter(), Counter()
    for text in texts:
        lines = text.split("\n")
        final = max((i for i, x in enumerate(lines) if x.strip()), default=-1)
        for i, line in enumerate(lines):
            tokens = line.split()
            for k, t in enumerate(tokens):
                last = k == len(tokens) - 1
                if i == final and last and t[-1] not in ".!?":
                    continue
                for words in {*pairs.last_words(tokens, k)}:
                    want[pairs.words_hash(words)] += 1
                    ended[pairs.words_hash(words)] += t[-1] in ".!?" and len(t) > 1 or last and i < final and t[-1] not in ".!?" and len(tokens) <= pairs.LINE_WORDS
    assert +places == +want and +ends == +ended
