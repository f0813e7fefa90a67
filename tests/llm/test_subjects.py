import random

from tidemark.llm import subjects

TERMS = {"law": "statute verdict notary clause affidavit probate".split(), "music": "violin chord overture refrain tempo melody".split(), "food": "yeast broth marinade dessert pantry garlic".split()}
DEAL = ["We decided to store the {} once and derive the {} from it.", "The chart plots the {} over time and marks each {} with a dot.", "A {} that lacks a {} is listed separately at the end."]
TALK = ["I moved the check into the loader and ran the suite, all tests pass.", "Nothing in the queue imports the old name any more, so I removed it.", "It is safe as long as the limit stays below the bound."]
PASSING = ["Somebody joked about a {} in the meeting, nothing to do with this.", "The demo used the word {} as filler text."]


def document(rnd, about):
    lines = [rnd.choice(TALK) for _ in range(rnd.randint(0, 4))]
    for s in about:
        lines += [rnd.choice(DEAL).format(rnd.choice(TERMS[s]), rnd.choice(TERMS[s])) for _ in range(rnd.randint(2, 5))]
    if rnd.random() < 0.3:
        lines.append(rnd.choice(PASSING).format(rnd.choice(TERMS[rnd.choice(sorted(TERMS))])))
    rnd.shuffle(lines)
    return "\n".join(lines)


def corpus(seed, n):
    rnd = random.Random(seed)
    about = [frozenset(rnd.sample(sorted(TERMS), rnd.choice([0, 1, 1, 1, 2]))) for _ in range(n)]
    return [(document(rnd, sorted(a)), a) for a in about]


def test_held_out_accuracy():
    train = [x for x in corpus(1, 300) if x[1]]
    test = corpus(3, 300)
    m = subjects.train(sorted(TERMS), train, [t for t, _ in [*train, *corpus(2, 100), *test]])
    scores = m.document_scores([t for t, _ in test])
    got = {(i, m.subjects[j]) for i, row in enumerate(scores) for j, s in enumerate(row) if s >= m.least[j]}
    want = {(i, s) for i, (_, a) in enumerate(test) for s in a}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_tables(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(4, 250))]
    labels = [(i, s) for i, (_, a) in enumerate(corpus(4, 250)) for s in a]
    extra = [(1000, None), (1001, ""), (1002, " \n "), (1003, "{}[]\n- a/b.py\n- c/d.py"), (None, rows[0][1]), (1004, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows + extra], "doc_id bigint, text string, subject string, score string")
    lab = spark.createDataFrame(labels + labels[:20] + [(None, "law"), (5, None), (6, "unknown"), (99_999, "law")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, "d") for s in TERMS] + [(None, "d")], "subject string, description string")
    m = subjects.learn(docs, lab, areas)
    got = {(r.doc_id, r.subject) for r in subjects.assign(docs, m).collect()}
    want = {(i, s) for i, s in labels}
    assert len(got & want) > 0.95 * len(want) and not [x for x in got if x[0] is None or x[0] >= 1000]
    comp = {r.subject: r for r in subjects.composition(subjects.assign(docs, m), docs).collect()}
    assert set(comp) == {*TERMS, "none"} and sum(r.documents for r in comp.values()) >= 255


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, subject string")
    areas = spark.createDataFrame([("law", "d")], "subject string, description string")
    m = subjects.learn(docs, lab, areas)
    assert subjects.assign(docs, m).count() == 0 and subjects.composition(subjects.assign(docs, m), docs).count() == 0
    some = spark.createDataFrame([(1, "A statute that lacks a clause is listed.")], "doc_id bigint, text string")
    assert subjects.assign(some, m).count() == 0


def test_labelled_documents_are_used_beyond_five_thousand(spark, monkeypatch):
    seen = []
    fit = subjects.fit
    monkeypatch.setattr(subjects, "fit", lambda areas, labelled: seen.append(len(labelled)) or fit(areas, labelled[:50]))
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    lab = spark.range(6_000).selectExpr("id as doc_id", "'law' as subject")
    areas = spark.createDataFrame([("law", "d")], "subject string, description string")
    subjects.learn(docs, lab, areas)
    assert seen == [6_000]


def test_counts_of_a_table_are_those_of_its_texts(spark):
    train = [x for x in corpus(1, 120) if x[1]]
    seeds = subjects.fit(sorted(TERMS), train)
    texts = [t for t, _ in corpus(5, 200)] + [None, ""]
    got = subjects.count_documents(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), seeds)
    want = subjects._counted(seeds, texts)
    assert want.uni.sum() > 0 and all((a == b).all() for a, b in zip(got, want))


def test_scores_are_differences_of_cross_entropies_per_token():
    train = [x for x in corpus(1, 200) if x[1]]
    m = subjects.train(sorted(TERMS), train, [t for t, _ in train])
    one = m.sentence_scores(subjects.corpus([DEAL[0].format("violin", "chord")]))[0]
    assert one.argmax() == m.subjects.index("music") and one.max() > 0 > sorted(one)[1]
    unknown = m.sentence_scores(subjects.corpus(["qq ww ee rr"]))[0]
    assert abs(unknown).max() < 0.5  # what no model has seen tells nothing
