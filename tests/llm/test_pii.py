import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

NAMES = pii.Names(["edda", "oriol", "jean-luc"], ["vintovsen", "halbucci", "aldrierre", "quintovsen", "maltovsen"])


def kinds(text):
    return [(x.kind, text[x.begin:x.end]) for x in pii.find(text, NAMES)]


@pytest.mark.parametrize("kind,value", [
    ("email", "a.b+c@mail.host.example"), ("email", "a_b (at) mail dot host-lab dot example"), ("email", "AB[at]host.test"), ("email", "ab @ office.host.test"), ("email", "jo at host dot example"), ("email", "аnna@host.example"), ("email", "jo​hn@host.example"),
    ("phone", "+49 30 23125 727"), ("phone", "(030) 23125 619"), ("phone", "030 / 23125084"), ("phone", "07700 900 849"), ("phone", "1-676-555-0138 ext. 37"), ("phone", "(457) 555-0191"), ("phone", "211.555.0181"), ("phone", "+33(0)199001183"), ("phone", "01.99.00.51.74"), ("phone", "600-124-014"),
    ("phone", "five five five zero one nine nine two three four".replace("five five five", "five five five", 1)), ("phone", "+４９ 30 23125 727"),
    ("id_number", "929-86-0000"), ("id_number", "992 88 6449"), ("id_number", "2 57 10 99 761 694 20"), ("id_number", "192119919401661"), ("id_number", "66 639 990 511"), ("id_number", "50.003.803-D"), ("id_number", "74509681-P"), ("id_number", "X0781701T"), ("id_number", "K32Z74152"),
    ("address", "48 Quarry Street, Apt 23, Quillbury 31950"), ("address", "47b Juniper St."), ("address", "Kranichweg 106b, 10829 Ostermoor"), ("address", "Calle de los Olmos nº 31a, 33890 Norrick"), ("address", "C/ Almendro, 76, 13931 Graufeld"), ("address", "198, place de la Fontaine, 44300 Tressel"), ("address", "229 boulevard des Écluses"),
    ("name", "Edda Vintovsen"), ("name", "EDDA VINTOVSEN"), ("name", "edda vintovsen"), ("name", "Vintovsen, Edda"), ("name", "Edda T. Vintovsen-Halbucci"), ("name", "Oriol von Aldrierre"), ("name", "von Aldrierre, Oriol"), ("name", "Edda Neutovsen"),
])
def test_found_with_exact_span(kind, value):
    for text in (f"Please see {value} for this", f"x={value}", f"{value}\nnext line", f'"{value}"'):
        if kind == "email" and " at " in value and text.startswith("x="):
            continue
        assert kinds(text) == [(kind, value)], text
        assert pii.redact(text, pii.find(text, NAMES)) == text.replace(value, pii.PLACEHOLDERS[kind])


@pytest.mark.parametrize("text", [
    "remote: git@forge.writer.example:reader/registry.git", "npm install @notifier/splitter@1.11.33", "listening on 192.0.2.193:39707", "sha256 8f41beadbca2ef38e5f2aaa1acbe9d07", "request d67e13ac-c066-4120-930c-f27f440ada01 timed out",
    "build 0.60.67-55186 finished", "range 2025-12-01..2025-01-21, shard 8/64", "offset 129264085, epoch 1738213130830", "2025-06-20T08:11:53.402Z TRACE [metrics] took 803 s", "at f (a/b.ts:1712:27)", "@vault.canvas(retries=3)", "The Session Selector board is green, 5d6fff2137.",
    "stays in place until 3.27.18", "one of them is null", "I measured 12 ms before and 34 s after", "", "   "])
def test_not_found(text):
    assert kinds(text) == []


def test_introduced_names():
    for text in ("My name is Zora Quill and I am new.", "Signed-off by: Zora Quill\n", "reviewer=QUILL, ZORA status=open", "Merci de prévenir Zora de la Quill avant la fusion.", "Zora Quill reported it on Monday"):
        assert [k for k, _ in kinds(text)] == ["name"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.example", "x (at) y dot test", "929-86-0000", "Edda Vintovsen", "ｆｕｌｌ", "​", "five five", " ", "\r\n", "text", "é", "😀", "+49 30 23125 727", "(", ".", "1"]), max_size=12))
def test_all_else_stays_as_it_is(parts):
    text = " ".join(parts)
    found = pii.find(text, NAMES)
    out, at = [], 0
    for x in found:
        assert at <= x.begin < x.end <= len(text)
        out += [text[at:x.begin], pii.PLACEHOLDERS[x.kind]]
        at = x.end
    assert pii.redact(text, found) == "".join(out) + text[at:]


def test_table(spark):
    schema = "memory_id bigint, user_prompt string, assistant_response string, pii_type string, begin string"
    rows = [(i, f"My name is {n} and I wrote this", None, "x", "y") for i, n in enumerate(["Zora Quillton", "Zora Marton", "Zora Quillton", "Edo Quillton", "Edo Marton"])]
    rows += [(10, "zora quillton was here, and edo marton", "call (457) 555-0191"), (10, "zora quillton was here, and edo marton", "call (457) 555-0191"), (11, None, ""), (None, "a@b.example", None), (12, "word " * 50_000 + "a@b.example", None)]
    df = spark.createDataFrame([(*r, "x", "y")[:5] for r in rows], schema)
    got = {(r.memory_id, r.field, r.pii_type, r.pii_text) for r in pii.find_all(df).collect()}
    assert {x for x in got if x[0] >= 10} == {(10, "user_prompt", "name", "zora quillton"), (10, "user_prompt", "name", "edo marton"), (10, "assistant_response", "phone", "(457) 555-0191"), (12, "user_prompt", "email", "a@b.example")}
    texts = {r.memory_id: r for r in pii.redact_all(df).collect()}
    assert texts[10].user_prompt == "[NAME] was here, and [NAME]" and texts[11].user_prompt is None and texts[11].replaced == 0
    assert pii.find_all(df.limit(0)).count() == 0 and pii.redact_all(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,kind,value", [
    ("at 48 Quarry Str\u0435et now", "address", "48 Quarry Str\u0435et"), ("at 48 Quarry Str\u200beet now", "address", "48 Quarry Str\u200beet"), ("my f\u0456ve f\u0456ve f\u0456ve zer\u043e zer\u043e zer\u043e zer\u043e zer\u043e zer\u043e line", "phone", "f\u0456ve f\u0456ve f\u0456ve zer\u043e zer\u043e zer\u043e zer\u043e zer\u043e zer\u043e"),
    ("to jo \u0430t host d\u043et example", "email", "jo \u0430t host d\u043et example"), ("\u201c48 Quarry Street\u201d", "address", "48 Quarry Street"), ("\u00abCalle de los Olmos 31\u00bb", "address", "Calle de los Olmos 31"), ("\u201eEdda Vintovsen\u201c", "name", "Edda Vintovsen"), ("\u00ab\u00a0Edda Vintovsen\u00a0\u00bb", "name", "Edda Vintovsen"),
    ("call five five five five five five five five five", "phone", "five five five five five five five five five"), ("to ab [ at ] host.test", "email", "ab [ at ] host.test"), ("to ab {@} host.test", "email", "ab {@} host.test")])
def test_disguises_and_typography_do_not_hide(text, kind, value):
    assert kinds(text) == [(kind, value)]


def test_words_end_at_whatever_is_no_letter():
    assert pii.words_of("\u201cRue\u201d\u00a0\u2014x\u00b2y \u00e9t\u00e9_STRASSE9Stra\u00dfe") == {x.encode() for x in ("rue", "x", "y", "\u00e9t\u00e9", "strasse")}


@pytest.mark.parametrize("kind,value", [("phone", "030 / 23125084"), ("phone", "(457) 555-0191"), ("phone", "0301 312 5084"), ("id_number", "929-86-0000"), ("id_number", "50.003.803-D")])
def test_numbers_after_a_date(kind, value):
    for date in ("2025-06-20 ", "[2025-06-20] ", "2025-06-20  "):
        text = f"{date}{value} ok"
        assert kinds(text) == [(kind, value)], text


@pytest.mark.parametrize("before", ["I am called ", "Best,\n", "Kontakt: ", "kontakt=", "Contacto: ", "contacto=", "Merci,\n", "Merci !\n"])
def test_introductions_that_suffice(before):
    assert kinds(f"{before}Zora Quill\n") == [("name", "Zora Quill")]


def test_introductions_teach_names(spark):
    rows = [(1, "Kontakt: Zora Quillton", "Best,\nZora Quillton"), (2, "so zora quillton said", None)]
    df = spark.createDataFrame(rows, "memory_id bigint, user_prompt string, assistant_response string")
    assert ("zora quillton",) in {(r.pii_text,) for r in pii.find_all(df).collect()}


@pytest.mark.parametrize("most", [3, 1000])
def test_names_beyond_the_lexicon_that_is_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "LEXICON", most)
    people = ["Zora Quillton", "Edo Marbelton", "Ilka-Mae Varnhalt", "Bero Sandelton"]
    rows = [(i, f"My name is {n}, hello", None) for i, n in enumerate(people * 2)]
    rows += [(20, "so zora quillton and Varnhalt, Ilka-Mae spoke", "Bero Sandelton-Varnhalt left")] * 2 + [(21, "with Edo Newbelton here", None), (None, "edo marbelton", ""), (22, None, None)]
    df = spark.createDataFrame(rows, "memory_id bigint, user_prompt string, assistant_response string")
    got = sorted((r.memory_id, r.pii_text) for r in pii.find_all(df).collect() if r.memory_id >= 20)
    assert got == sorted([(20, "zora quillton"), (20, "Varnhalt, Ilka-Mae"), (20, "Bero Sandelton-Varnhalt")] * 2 + [(21, "Edo Newbelton")])
    redacted = pii.redact_all(df).collect()
    assert len(redacted) == len(rows) and ("[NAME]", 1) in {(r.user_prompt, r.replaced) for r in redacted} and sum(r.replaced for r in redacted) == 8 + 6 + 1 + 1


@pytest.mark.parametrize("text,value", [
    ("my name is J\u043ehn Smith here", "J\u043ehn Smith"), ("my name is J\u200bohn Smith here", "J\u200bohn Smith"), ("so \u0435dda vint\u043evsen said", "\u0435dda vint\u043evsen"), ("so Edda Vint\u00adovsen said", "Edda Vint\u00adovsen")])
def test_disguised_names(text, value):
    assert kinds(text) == [("name", value)]


def test_account_numbers_are_no_phone_numbers():
    assert kinds("pay to DE44 0044 0532 0130 0012 34 today") == [] and kinds("pay to DE44004405320130001234 today") == []
    assert kinds("pay DE44 0044 0532 0130 0012 34 or call (457) 555-0191") == [("phone", "(457) 555-0191")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.example", "x (at) y dot test", "jo at host dot example", "929-86-0000", "Edda Vintovsen", "V\u0456ntovsen, Edda", "f\u0456ve five", "five two", "zero", "48 Quarry Str\u0435et", "Kranichweg 106b", "my name is", "Zora Quill",
                                 "\u200b", "\n", "\u201c", "+49 30 23125 727", "12 rue des Lilas", "reported it", "de", "DE44 0044 0532 0130 0012 34", "."]), max_size=10))
def test_gates_change_nothing(parts):
    text = " ".join(parts)
    assert pii.find(text, NAMES) == pii.find(text, NAMES, gated=False)


def test_contexts_are_learned(spark):
    people = [f"{g} {f}ton" for g in ("Zora", "Edo", "Ilka", "Bero") for f in ("Quill", "Marbel", "Varn")]
    rows = [(i, f"My name is {n}, hello", None) for i, n in enumerate(people * 2)]
    rows += [(100 + i, f"then please ask for {n} when it fails", None) for i, n in enumerate(people)]
    rows += [(200, "then please ask for Ursel Humbrecht when it fails", None), (201, "then see Load Balancer Ursel Humbrecht", "ask for it")]
    rows += [(300 + i, "so my name is Row Counter and the row is a row in this row of the row", None) for i in range(3)]
    df = spark.createDataFrame(rows, "memory_id bigint, user_prompt string, assistant_response string")
    lexicon, learned = pii.introduced_words(df)
    assert "ask for " in learned and ("g", "row") not in {tuple(r) for r in lexicon.collect()}
    got = {(r.memory_id, r.pii_text) for r in pii.find_all(df).collect() if r.memory_id in (200, 201)}
    assert got == {(200, "Ursel Humbrecht")}
