"""Personal information in free text: find it and put typed placeholders (problem 2).

Offset-preserving deobfuscation: a chain of small transducers rewrites disguises
(look-alike letters, zero-width characters, spelled digits, at/dot disguises)
and keeps, for each character of the result, the source characters it came from.
Identifiers are detected in the rewritten text and their spans mapped back, so
what is reported is the exact source substring and everything else stays as it is.

Names have no form of their own. A few seed phrases ("my name is …", in four
languages) introduce people; the given and family names they introduce anywhere
in the corpus form a lexicon. The words that stand before names of the lexicon
are counted over the whole corpus, and those n-grams after which such names
mostly stand become introductions themselves, whose names join the lexicon. By
it the same people, and new combinations, are found without any introduction.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.langid import SEEDS
from tidemark.runtime import cut

FIELDS = ("user_prompt", "assistant_response")
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
#: Introductions that make a word part of the lexicon.
SEEN = 2
#: Known names that must stand after a context for it to be learned: this many, and this share of all known names seen
#: (so that there are 1,000 contexts at most); and the least share of names in all that stands there in the form of a name.
CONTEXT_SEEN, CONTEXT_SHARE, CONTEXT_NAMES = 5, 1e-3, 0.4
#: Least share of a given name's occurrences that begin with a capital.
CAPITAL = 0.3
#: Most words of a lexicon that is broadcast, about 20 MB; the words of a larger one are joined to the texts that hold them.
LEXICON = 200_000


class Found(NamedTuple):
    kind: str
    begin: int
    end: int


# --- transducers -----------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХУІЈЅαονρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXYIJSaovpiktuABEZHIKMNOPTYX"))
#: Words for digits.
DIGIT_WORDS = {
    "0": "zero oh null nul cero zéro", "1": "one eins uno un", "2": "two zwei zwo dos deux", "3": "three drei tres trois", "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq", "6": "six sechs seis", "7": "seven sieben siete sept", "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
_DIGIT_BYTES = frozenset(w.encode() for ws in DIGIT_WORDS.values() for w in ws.split())
_DIGIT_OF = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_DIGIT = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_DIGIT})(?:[ \-,.]{{1,2}}(?:{_DIGIT}))+\b", re.I)
_AT = re.compile(r"(?<=[\w+%-])\s?[\[({<]\s?(?:at|ät|arroba|arobase|@)\s?[\])}>]\s?(?=\w)|(?<=[\w+%-]) @ (?=\w)|(?<=[\w+%-]) (?:at|arroba|arobase) (?=[\w-]+(?: (?:dot|punto|punkt|point) [\w-]+)+)", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|punto|punkt|point|\.)\s?[\])}>]\s?| (?:dot|punto|punkt|point) ", re.I)
_AT_BYTES = frozenset(("ät".encode(), b"arroba", b"arobase"))
_DOT_BYTES = frozenset((b"dot", b"punto", b"punkt", b"point"))
_AT_MARK = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]| @ ", re.I)
_DOMAIN = re.compile(rf"@[\w-]+(?:(?:\.|{_DOT.pattern})[\w-]+)*", re.I)


#: ASCII that stands between words, and all else that is no letter.
_BETWEEN = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


class _Letters(dict):
    """What a word with bytes beyond ASCII falls into where all that is no letter is taken out."""

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) > 1 << 17:
            self.clear()
        t = word.decode("utf-8", "replace")
        out = self[word] = [word] if t.isalpha() else "".join(c if c.isalpha() else " " for c in t).encode().split()
        return out


_LETTERS = _Letters()


def _split(text: str) -> list[bytes]:
    """The case-folded words of a text as UTF-8; all but letters stands between them."""
    words = text.casefold().encode("utf-8", "replace").translate(_BETWEEN).split()
    return words if text.isascii() else [x for w in words for x in ((w,) if w.isascii() else _LETTERS[w])]


def words_of(text: str) -> frozenset[bytes]:
    """The distinct words, a cheap way to see what cannot be in a text."""
    return frozenset(_split(text))


class Rewritten(NamedTuple):
    """A text, and for each of its characters the half-open source range it stands for (``None``: its own)."""

    text: str
    ranges: list[tuple[int, int]] | None

    def source(self, begin: int, end: int) -> tuple[int, int]:
        if self.ranges is None:
            return begin, end
        return self.ranges[begin][0], self.ranges[end - 1][1]

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
        """Replace disjoint ascending ranges; each new character stands for the whole range it replaces."""
        out, ranges, at = [], [], 0
        own = self.ranges or [(i, i + 1) for i in range(len(self.text))]
        for begin, end, new in edits:
            out += [self.text[at:begin], new]
            ranges += own[at:begin]
            ranges += [(own[begin][0], own[end - 1][1])] * len(new)
            at = end
        return Rewritten("".join(out) + self.text[at:], ranges + own[at:])


#: Characters that may be read as others.
_ODD = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + "\uff00-\uffef\U0001d400-\U0001d7ff" + "".join(ch for ch in map(chr, range(0x80, 0x11000)) if unicodedata.category(ch) in ("Cf", "Nd")) + "]")


def _plain(ch: str) -> str | None:
    """What a non-ASCII character is read as, or None if it stays."""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(ch))
    if not ("\uff00" <= ch <= "\uffef" or "\U0001d400" <= ch <= "\U0001d7ff"):
        return None
    plain = unicodedata.normalize("NFKC", ch)  # full-width and mathematical letters
    return plain if len(plain) == 1 and plain.isascii() else None


def _may(keys: frozenset[bytes], words: frozenset[bytes] | None) -> bool:
    """Whether one of the keys may be among the words of a text; without words, anything may."""
    return words is None or not keys.isdisjoint(words)


def plain_characters(text: str) -> Rewritten:
    """The first transducer: characters that stand for others."""
    if text.isascii():
        return Rewritten(text, None)
    edits = [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain(m.group())) is not None]
    # letters of another script count as disguised only in words that are Latin otherwise
    edits = [e for e in edits if text[e[0]] not in LOOK_ALIKES or any("a" <= c.lower() <= "z" or c in "@." for c in text[max(0, e[0] - 1):e[0] + 2])]
    return Rewritten(text, None).replace(edits) if edits else Rewritten(text, None)


def rewrite(text: str, words: frozenset[bytes] | None = None, gated: bool = True) -> Rewritten:
    """Undo disguises; most texts come back unchanged and without a map. ``gated`` looks only for what the words allow, with the same result."""
    r = plain_characters(text)
    # a disguise may hide a word, so what the text can hold is seen in the rewritten one
    words = None if not gated else words_of(r.text) if words is None or r.ranges is not None else words
    digits = _DIGIT_BYTES if words is None else _DIGIT_BYTES & words
    if words is None or len(digits) >= 2 or digits and sum(w in digits for w in _split(r.text)) >= 2:
        edits = [(m.start(), m.end(), "".join(_DIGIT_OF[w.lower()] for w in re.split(r"[ \-,.]+", m.group()))) for m in _SPELLED.finditer(r.text)]
        if edits:
            r = r.replace(edits)
    if _may(_AT_BYTES, words) or b"at" in words and not _DOT_BYTES.isdisjoint(words) or (b"at" in words or "@" in r.text) and _AT_MARK.search(r.text):
        edits = [(m.start(), m.end(), "@") for m in _AT.finditer(r.text)]
        if edits:
            r = r.replace(edits)
            dots = [(m.start() + d.start(), m.start() + d.end(), ".") for m in _DOMAIN.finditer(r.text) for d in _DOT.finditer(m.group())]
            if dots:
                r = r.replace(dots)
    return r


# --- forms -----------------------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+%/:@-])[A-Za-z0-9_](?:[\w.+%-]*[\w+%-])?@(?>(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])(?!:[\w/~]|/|@|\()")
#: Forms of identity, tax, social security and passport numbers.
_IDS = (
    r"\d{3}([- ])\d{2}\1\d{4}",  # social security and taxpayer numbers of nine digits
    r"[12]([ .]?)\d{2}\1(?:0[1-9]|1[0-2]|[2-4]\d)\1\d{2}\1\d{3}\1\d{3}(?:\1\d{2})",  # registration number of fifteen digits
    r"\d{2} \d{3} \d{3} \d{3}|\d{11}",  # tax number of eleven digits
    r"\d{2}\.\d{3}\.\d{3}-?[A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]",  # identity numbers with a check letter
    r"[A-Z]\d{2}[A-Z]\d{5}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{7}\d",  # document numbers of nine characters
)
_SIDE_L, _SIDE_R = r"(?<![\w./#@+-])(?<!\d:)", r"(?![\w@/]|[.:-]\w)"
_ID = re.compile("|".join(f"(?P<k{i}>{_SIDE_L}(?:{p.replace(chr(92) + '1', f'(?P=s{i})').replace('([- ])', f'(?P<s{i}>[- ])').replace('([ .]?)', f'(?P<s{i}>[ .]?)')}){_SIDE_R})" for i, p in enumerate(_IDS)))
#: Forms of phone numbers.
_PHONES = (
    r"(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(0\)[ .-]?|[ ./-]{0,3})\(?\d{1,5}\)?(?:[ ./-]?\d{2,9}){1,5}",  # with country prefix
    r"(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}|1 \d{3} \d{3} \d{4}",  # ten digits
    r"\(0\d{1,5}\)[ /-]{0,3}\d{3,9}(?:[ -]?\d{2,6}){0,3}|0\d{1,5} ?[/-] ?\d{5,9}(?:[ -]\d{2,5}){0,2}",  # area code in parentheses or before a slash
    r"0\d(?:[ .-]?\d{2}){4}|0\d{4}[ -]\d{3} ?\d{3}|0\d{3} \d{3} \d{4}",  # ten or eleven digits with trunk prefix
    r"[6789]\d{2}([ -])\d{3}\1\d{3}|[6789]\d{2} \d{2} \d{2} \d{2}",  # nine digits
)
_EXTENSION = r"(?:,? ?(?:ext\.?|extension|x|Durchwahl|poste) ?\d{1,6})?"
_PHONE = re.compile("|".join(f"(?P<k{i}>(?<![\\w./#@+-])(?<!\\d:)(?:{p.replace(chr(92) + '1', f'(?P=s{i})').replace('([.-])', f'(?P<s{i}>[.-])').replace('([ -])', f'(?P<s{i}>[ -])')}){_EXTENSION}(?![\\w@/]|[.:-]\\w|\\(\\)))" for i, p in enumerate(_PHONES)))
#: Where one of these may stand: eight or more digits with their separators, or nine capitals and digits.
_NUMBERS = (re.compile(r"\d[\d ./()-]{6,}\d"), re.compile(r"[A-Z]-?(?=\w*\d)[A-Z0-9]{7}-?[A-Z0-9](?!\w)"))
_SAID = re.compile(r"(?<!\w)\+?\d{9,13}(?!\w)")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?![\d-])")

_CAP = r"[A-ZÀ-Ý][\wÀ-ÿ'’]*"
_TOWN = rf"{_CAP}(?:[ -](?:(?:am|an der|im|sur|de|del|la|le|les|el) )?{_CAP}){{0,2}}"
_NO = r"\d{1,5}(?: ?[a-zA-Z](?![\w]))?"
_ZIP_TOWN = rf"(?:,? (?:[A-Z]{{1,2}}-)?\d{{5}} {_CAP}(?:-{_CAP})?|, {_CAP}(?:-{_CAP})?(?: \d{{5}}(?!\d))?(?=[\s.,;:!?\"')\]|}}]|$))?"
_UNIT = r"(?:,? (?:Apt|Apartment|Unit|Suite|Flat|Ste|No|Room|Fl)\.? ?#?\d{1,5}[a-zA-Z]?|, #\d{1,5}|,? (?:bât|bâtiment|appt|appartement|piso|puerta|esc|escalera|Whg|Wohnung|Hinterhaus)\.? ?\w{1,5})*"
_EN_TYPE = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Terrace|Place|Square|Way|Boulevard|Blvd\.?|Close|Crescent|Parkway|Row|Walk|Hill|Grove|Gardens)"
_DE_TYPE = r"(?:weg|stra(?:ß|ss)e|str\.|platz|gasse|allee|kamp|stieg|steig|ufer|damm|ring|hof|graben|markt|wall|chaussee|pfad|park)"
_ES_TYPE = r"(?:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Paseo|P\.º|Plaza|Pl\.|Camino|Ronda|Travesía|Carretera|Cuesta|Glorieta)"
_FR_TYPE = r"(?:rue|avenue|av\.|place|boulevard|bd|chemin|impasse|allée|quai|cours|route|square|passage|sentier)"
_LINK = r"(?:de la |de los |de las |del |de |des |du |de l['’]|d['’]|la |las |los |le |les |el |à |aux )"
#: Words that begin a French sentence rather than go on with a street's name.
_STARTS = r"(?:[CDJLMNST]['’]|(?:À|Ajoute|Annule|Après|Au|Aussi|Avant|Bonjour|Ce|Cela|Ces|Cette|Comment|Dans|De|Depuis|Des|Elle|Elles|En|Ensuite|Est|Et|Il|Ils|Je|La|Le|Les|Mais|Merci|Mon|Ne|Notre|Nous|On|Ou|Où|Oui|Non|Par|Peut|Peux|Pour|Pourquoi|Quand|Que|Qui|Quoi|Renomme|Sans|Ses|Si|Son|Sur|Tu|Un|Une|Votre|Vous|Voici|Voilà)\b)"
def _bytes(words: str) -> frozenset[bytes]:
    return frozenset(w.casefold().encode() for w in words.split())


_BEFORE_NO = re.compile(r"[a-zß.] \d")
#: How German streets end, by themselves or as the end of a longer word.
_DE_ENDS = tuple(x for w in "weg straße strasse str. platz gasse allee kamp stieg steig ufer damm ring hof graben markt wall chaussee pfad park".split() for x in (w, w.capitalize()))
#: For each language: words without which there is no address, what must stand around a number, and the form.
_ADDRESSES = [
    (_bytes("street st road rd lane ln avenue ave drive dr court ct terrace place square way boulevard blvd close crescent parkway row walk hill grove gardens"), re.compile(r"\d[a-zA-Z]? [A-ZÀ-Ý]").search,
     re.compile(rf"(?<![\w./:-]){_NO} (?:{_CAP} ){{1,3}}{_EN_TYPE}(?!\w){_UNIT}{_ZIP_TOWN}")),
    (None, lambda t: any(t[max(0, m.start() - 8):m.start() + 1].endswith(_DE_ENDS) for m in _BEFORE_NO.finditer(t)),
     re.compile(rf"(?<![\w./:-])(?:{_CAP}{_DE_TYPE}|(?:{_CAP}[ -]){{1,2}}(?:Weg|Stra(?:ß|ss)e|Str\.|Platz|Gasse|Allee|Ring|Ufer|Damm)) {_NO}(?![\w/.:-]\w){_UNIT}{_ZIP_TOWN}")),
    (_bytes("calle c avenida avda av paseo plaza pl p camino ronda travesía carretera cuesta glorieta"), re.compile(rf"{_ES_TYPE} ").search,
     re.compile(rf"(?<!\w){_ES_TYPE} (?:{_LINK}|{_CAP} ){{0,4}}{_CAP},? (?:(?:nº|n\.º|núm\.?|número|no\.) ?)?{_NO}(?![\w/.:-]\w){_UNIT}{_ZIP_TOWN}")),
    (_bytes("rue avenue av place boulevard bd chemin impasse allée quai cours route square passage sentier"), re.compile(rf"\d(?: ?[a-zA-Z])?(?: bis| ter)?,? {_FR_TYPE} ").search,
     re.compile(rf"(?<![\w./:-]){_NO}(?: (?:bis|ter))?,? {_FR_TYPE} {_LINK}?{_CAP}(?:[ -](?:{_LINK})?(?!{_STARTS}){_CAP}){{0,3}}{_UNIT}{_ZIP_TOWN}")),
]

# --- names -----------------------------------------------------------------------------------------------------------

_PARTICLE = r"(?:(?:von|van|de|del|della|der|den|di|da|dos|la|le|zu|ter|ten) |d['’])"
_T, _U = r"[A-ZÀ-Ý][a-zà-ÿ'’]+", r"[A-ZÀ-Ý'’]{2,}"
_NAME = "|".join(
    rf"(?P<g{i}>{w}(?:-{w})?)(?: [A-ZÀ-Ý]\.){{0,2}} (?P<f{i}>(?:{p}){{0,2}}{w}(?:-{w})?)(?![\w-])|(?P<f{i + 1}>(?:{p}){{0,2}}{w}(?:-{w})?), (?P<g{i + 1}>{w}(?:-{w})?)(?: [A-ZÀ-Ý]\.)*(?![\w-])"
    for i, w, p in ((0, _T, _PARTICLE), (2, _U, f"(?:{_PARTICLE}|(?:VON|VAN|DE|DEL|DER|DI|DA|LA) )")))
#: Seed phrases that introduce a person; a name follows.
BEFORE = (
    "my name is ", "i am called ", "talked to ", "spoke with ", "spoke to ", "signed-off by: ", "signed-off-by: ", "reviewed by ", "reviewed-by: ", "co-authored-by: ",
    "reviewer=", "reviewer: ", "assignee: ", "assignee=", "author: ", "author=", "contact: ", "regards,\n", "thanks!\n", "thanks,\n", "best,\n", "cheers,\n",
    "mein name ist ", "ich heiße ", "gesprochen mit ", "bearbeiter: ", "bearbeiter=", "grüße\n", "grüßen\n", "gruß\n", "kontakt: ", "kontakt=", "zuständig: ",
    "je m'appelle ", "je m’appelle ", "prévenir ", "responsable : ", "responsable: ", "responsable=", "cordialement,\n", "cordialement\n", "merci,\n", "merci !\n",
    "me llamo ", "mi nombre es ", "avisa a ", "hablé con ", "contacto: ", "contacto=", "saludos,\n", "gracias,\n", "¡gracias!\n",
)
#: What follows a person who did something.
AFTER = (" reported it", " wrote in", " hat den Fehler gemeldet", " hat gemeldet", " a signalé", " informó del", " avisó de")
_NAME_AT = re.compile(_NAME)
#: Where a name may begin: a capitalised word before another, or before particles; those before a family name that comes first.
_PAIR = re.compile(r"[A-ZÀ-Ý][\w'’-]+(?: [A-ZÀ-Ý]\.){0,2},? (?=[A-ZÀ-Ý]|(?:von|van|de|del|della|der|den|di|da|dos|la|le|zu|ter|ten) |d['’])")
_LED = re.compile(rf"(?:{_PARTICLE}){{1,2}}\Z", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Words of closed classes beside the seed words of the languages; they begin sentences and are no names.
_CLOSED = (
    "a about all also an any as at both by each either every he her here his i if in its let me my neither no nor nothing off once one or other our out over please she since so some such there these they those though through under until up us very we while whose within yes yet you your "
    "alle allem am an ans beim bitte da dann dem des deren dessen diese dieser dieses du er es euch ihr im in ins ja jede jeder kein keine man mein mich mir nein ob sehr sein seine seit so uns unser vom weil wer wo "
    "à ainsi alors après car chaque chez comme donc dont eux ici ils je là leur lorsque lui ma me même mon ni non notre nos on oui puis quand quel quelle quoi sa se si son ta te tes ton tu votre vos y "
    "a ahora algo ante aquí así aunque cada cual desde donde e él ella ellos entre eso ese hasta hay le les mi mis nada ni nos o otra otro porque quien si sí sino sus tan tanto te tu tus unas unos yo"
)
_NO_NAMES = frozenset(w for words in (*SEEDS.values(), _CLOSED) for w in words.split())
#: What stands before a name: the rest of its own token, and one token more.
_LEFT = re.compile(r"(?<!\S)(?:\S{1,24}[^\S\n]+)?\S{0,24}\s*\Z")
_LEFT_SIZE, _CUE_SIZE = 52, max(map(len, BEFORE)) + 1


def candidates(text: str) -> Iterator[re.Match]:
    """Whatever has the form of a full name."""
    done = 0
    for pair in _PAIR.finditer(text):
        at = pair.start()
        if at < done or at and (text[at - 1].isalnum() or text[at - 1] == "-") or pair.group().strip(" ,").casefold() in _NO_NAMES:
            continue
        led = _LED.search(text, max(done, at - 12), at)
        m = led and not text[led.start() - 1:led.start()].isalnum() and _NAME_AT.match(text, led.start()) or _NAME_AT.match(text, at)
        if m and _NO_NAMES.isdisjoint(w for part in _parts(m) for w in part):
            done = m.end()
            yield m


def left_context(text: str, at: int) -> str:
    """The context n-gram before a position, empty if it has no letter."""
    m = _LEFT.search(text, max(0, at - _LEFT_SIZE), at)
    left = m.group().lower() if m else ""
    return left if any(map(str.isalpha, left)) else ""


def introduced(text: str, m: re.Match, learned: frozenset[str] = frozenset()) -> bool:
    """Whether a seed phrase, or a learned context, stands before a name, or what persons do after it."""
    left = text[max(0, m.start() - _CUE_SIZE):m.start()].lower()
    if left.endswith(BEFORE):
        size = max(len(c) for c in BEFORE if left.endswith(c))
        if not left[-size].isalpha() or not left[-size - 1:-size].isalnum():
            return True
    return text.startswith(AFTER, m.end()) or bool(learned) and left_context(text, m.start()) in learned


def _parts(m: re.Match) -> tuple[list[str], list[str]]:
    """Given and family name of a match, case-folded, without particles."""
    g = next(v for k, v in m.groupdict().items() if v and k[0] == "g")
    f = next(v for k, v in m.groupdict().items() if v and k[0] == "f")
    return [g.casefold()], [w for w in f.casefold().replace("-", " ").split() if not re.fullmatch(_PARTICLE, w + " ")]


class Names:
    """Given and family names, how family names end, and what introduces people."""

    def __init__(self, given: Iterable[str], family: Iterable[str], ends: frozenset[str] | None = None, learned: frozenset[str] = frozenset()):
        self.given, self.family = frozenset(given) - _NO_NAMES, frozenset(family)
        self.learned = learned
        # of a hyphenated name the last part shows in a text's words
        self.shown = frozenset(max(words_of(w), key=len) for w in self.given if words_of(w))
        if ends is None:
            ends = frozenset(e for e, n in Counter(w[-4:] for w in self.family if len(w) >= 6).items() if n >= 3)
        self.ends = ends

    def is_family(self, word: str) -> bool:
        parts = [w for w in word.casefold().split("-") if w]
        return bool(parts) and all(w in self.family or len(w) >= 6 and w[-4:] in self.ends for w in parts)

    def find(self, text: str, present: frozenset[bytes] | None) -> Iterator[tuple[int, int]]:
        for m in candidates(text):
            if introduced(text, m, self.learned):
                yield m.start(), m.end()
        if not _may(self.shown, present):
            return
        words = list(_WORD.finditer(text))
        for i, w in enumerate(words):
            if w.group().casefold() not in self.given:
                continue
            end, k = w.end(), i + 1
            particles = 0
            while k < len(words):
                gap, t = text[end:words[k].start()], words[k].group()
                if len(t) == 1 and gap == " " and text[words[k].end():words[k].end() + 1] == "." and not particles:
                    end = words[k].end() + 1
                elif gap == " " and particles < 2 and re.fullmatch(_PARTICLE, t.casefold() + " "):
                    end, particles = words[k].end(), particles + 1
                else:
                    break
                k += 1
            if k < len(words) and text[end:words[k].start()] == " " and self.is_family(words[k].group()) and _same_case(w.group(), words[k].group()):
                yield w.start(), words[k].end()
                continue
            # family name first, with or without a comma
            if i and text[words[i - 1].end():w.start()] in (", ", " ") and self.is_family(words[i - 1].group()) and _same_case(words[i - 1].group(), w.group()):
                begin, j = words[i - 1].start(), i - 2
                while j >= 0 and text[words[j].end():begin] == " " and re.fullmatch(_PARTICLE, words[j].group().casefold() + " "):
                    begin, j = words[j].start(), j - 1
                tail = re.match(r"(?: [A-ZÀ-Ý]\.)+", text[w.end():])
                yield begin, w.end() + (tail.end() if tail else 0)


def _same_case(a: str, b: str) -> bool:
    return a.islower() == b.islower() and (a.isupper() == b.isupper() or len(a) < 2 or len(b) < 2)


NOBODY = Names((), ())


def find(text: str | None, names: Names = NOBODY, gated: bool = True) -> list[Found]:
    """Personal information of a text in order, as source spans that do not overlap.

    Everything is looked for in the rewritten text. ``gated`` skips what its
    words rule out, which changes nothing in the result.
    """
    if not text:
        return []
    words = words_of(text) if gated else None
    r = rewrite(text, words, gated)
    t = r.text
    shown = words if r.ranges is None or not gated else words_of(t)
    found: list[Found] = []
    taken: list[tuple[int, int]] = []

    def take(kind: str, begin: int, end: int) -> None:
        begin, end = r.source(begin, end)
        if all(end <= b or e <= begin for b, e in taken):
            taken.append((begin, end))
            found.append(Found(kind, begin, end))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            take("email", m.start(), m.end())
    if any(ch in t for ch in "0123456789"):
        for keys, gate, rx in _ADDRESSES:
            if (keys is None or _may(keys, shown)) and gate(t):
                for m in rx.finditer(t):
                    take("address", m.start(), m.end())
        # of a run that begins with a date, the date is passed over
        near = [(d.end() if (d := _DATE.match(t, m.start())) else max(0, m.start() - 8), m.end()) for rx in _NUMBERS for m in rx.finditer(t)]
        # a bank account number is none of the kinds, nor is a part of it
        if (accounts := [m.span() for m in _ACCOUNT.finditer(t)]) and near:
            near = [(b, e) for b, e in near if not any(x < e and b < y for x, y in accounts)]
        for kind, rx in (("id_number", _ID), ("phone", _PHONE)):
            for begin, end in near:
                for m in rx.finditer(t, begin, end + 60):
                    if m.start() < end:
                        take(kind, m.start(), m.end())
    if r.ranges is not None:
        for m in _SAID.finditer(t):
            begin, end = r.source(m.start(), m.end())
            if any(map(str.isalpha, text[begin:end])):  # said in words, so without the separators that tell a number's kind
                take("phone", m.start(), m.end())
    for begin, end in names.find(t, shown):
        take("name", begin, end)
    return sorted(found, key=lambda x: x.begin)


def redact(text: str | None, found: list[Found]) -> str | None:
    """The text with a placeholder in place of each span; null stays null."""
    if not text or not found:
        return text
    out, at = [], 0
    for x in found:
        out += [text[at:x.begin], PLACEHOLDERS[x.kind]]
        at = x.end
    return "".join(out) + text[at:]


# --- on tables -------------------------------------------------------------------------------------------------------

def _candidate_names(turns: DataFrame) -> DataFrame:
    """``kind, context, given, family, n`` of everything in the form of a name in either field of any row, in partial sums first.

    kind is i where a seed phrase introduces it and c otherwise, with the context
    before it. Kind l counts how often the given name stands in small letters in
    the same text.
    """
    names = ["kind", "context", "given", "family", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(zip(*seen)) or [[]] * 4
            out = pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys[:3]), pa.array(keys[3], pa.list_(pa.string())), pa.array(list(seen.values()), pa.int64())], names=names)
            seen.clear()
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                for column in batch.slice(k, 1000).columns:
                    for raw in column.to_pylist():
                        if raw:
                            t = plain_characters(raw).text
                            for m in candidates(t):
                                (g, *_), f = _parts(m)
                                seen[("i" if introduced(t, m) else "c", left_context(t, m.start()), g, tuple(f))] += 1
                                if low := t.count(f" {g} "):
                                    seen[("l", "", g, ())] += low
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    counts = turns.select(*FIELDS).mapInArrow(run, "kind string, context string, given string, family array<string>, n bigint")
    return cut(counts.groupBy("kind", "context", "given", "family").agg(F.sum("n").alias("n")), "names")


def _words(names: DataFrame) -> DataFrame:
    """``part, word, n``: the given (g) and family (f) names of counted names."""
    part = F.concat(F.array(F.struct(F.lit("g").alias("part"), F.col("given").alias("word"))), F.transform("family", lambda w: F.struct(F.lit("f").alias("part"), w.alias("word"))))
    return names.select(F.inline(part), "n").groupBy("part", "word").agg(F.sum("n").alias("n"))


def introduced_words(turns: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """``part, word``, the given and family names introduced often enough in either field of any row, and the contexts learned.

    The words that seed phrases introduce tell which names are known; a context
    is learned if enough known names stand after it, and enough of all names
    there are known; the words it introduces count too then. A given name that
    mostly stands in small letters is none.
    """
    all_ = _candidate_names(turns)
    names = all_.where("kind <> 'l'")
    seeds = _words(names.where("kind = 'i'")).where(F.col("n") >= SEEN)
    given, family = (seeds.where(F.col("part") == p).select(F.col("word").alias("w"), F.lit(1).alias("is")) for p in "gf")
    each = names.select("context", "given", "family", "n", F.monotonically_increasing_id().alias("k")).where("context <> ''")
    known = (each.select("context", "k", "n", "given", F.explode("family").alias("f")).join(given.withColumnRenamed("w", "given"), "given", "left_semi")
             .join(family.withColumnRenamed("w", "f"), "f", "left").groupBy("context", "k", "n").agg(F.min(F.coalesce("is", F.lit(0))).alias("is")).where("is = 1")
             .groupBy("context").agg(F.sum("n").alias("known")))
    known = cut(known, "contexts")
    total = known.agg(F.sum("known")).first()[0] or 0
    often = known.where(F.col("known") >= max(CONTEXT_SEEN, CONTEXT_SHARE * total))  # 1,000 at most
    learned = cut(each.join(F.broadcast(often), "context").groupBy("context").agg(F.sum("n").alias("n"), F.max("known").alias("known")).where(F.col("known") >= CONTEXT_NAMES * F.col("n")).select("context"), "learned")
    words = _words(names.join(F.broadcast(learned.withColumn("is", F.lit(1))), "context", "left").where("kind = 'i' or is = 1")).where(F.col("n") >= SEEN)
    upper = names.groupBy(F.lit("g").alias("part"), F.col("given").alias("word")).agg(F.sum("n").alias("upper"))
    lower = all_.where("kind = 'l'").groupBy(F.lit("g").alias("part"), F.col("given").alias("word")).agg(F.sum("n").alias("lower"))
    common = lower.join(upper, ["part", "word"]).where(F.col("upper") < CAPITAL * (F.col("upper") + F.col("lower"))).select("part", "word")
    return cut(words.select("part", "word").join(common, ["part", "word"], "left_anti"), "lexicon"), frozenset(r["context"] for r in learned.collect())


def _texts_and_names(turns: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[Names]]]:
    """The ids and texts of the turns, and a function that gives for each row of a batch the names to find in it.

    Up to ``LEXICON`` words every row has all names. Beyond, the words of each
    text are joined with the whole lexicon, so that a row has those it holds;
    how family names end is counted over the whole lexicon either way.
    """
    spark = turns.sparkSession
    lexicon, learned = introduced_words(turns)
    texts = turns.select("memory_id", *FIELDS)
    rows = lexicon.limit(LEXICON + 1).collect()
    if len(rows) <= LEXICON:
        names = spark.sparkContext.broadcast(Names((r["word"] for r in rows if r["part"] == "g"), (r["word"] for r in rows if r["part"] == "f"), learned=learned))
        return texts, lambda batch: [names.value] * batch.num_rows
    del rows
    # four letters, so few even of a large lexicon
    ends = lexicon.where((F.col("part") == "f") & (F.length("word") >= 6)).groupBy(F.substring("word", -4, 4).alias("e")).count().where("count >= 3").collect()
    shared = spark.sparkContext.broadcast(frozenset(r["e"] for r in ends))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                keys, held = [], []
                for key, *both in zip(*(c.to_pylist() for c in part.columns)):
                    own = {w.group().casefold() for t in both if t for w in _WORD.finditer(rewrite(t).text)}
                    own |= {x for w in own if "-" in w for x in w.split("-")}
                    keys += [key] * len(own)
                    held += own
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(held, pa.string())], names=["key", "word"])

    keyed = texts.withColumn("key", F.sha2(F.concat(F.coalesce("user_prompt", F.lit("")), F.lit("\n"), F.coalesce("assistant_response", F.lit(""))), 256))
    held = keyed.select("key", *FIELDS).mapInArrow(words, "key string, word string").join(lexicon, "word").groupBy("key").agg(F.collect_set(F.struct("part", "word")).alias("known"))

    def of(batch: pa.RecordBatch) -> list[Names]:
        return [Names([x["word"] for x in known or () if x["part"] == "g"], [x["word"] for x in known or () if x["part"] == "f"], shared.value, learned) for known in batch.column(3).to_pylist()]

    return keyed.join(held, "key", "left").select("memory_id", *FIELDS, "known"), of


def find_all(turns: DataFrame) -> DataFrame:
    """``memory_id, field, begin, length, pii_type, pii_text`` of every piece of personal information in every row.

    begin and length count code points. Rows without memory_id are left out;
    null, empty and blank texts hold none; repeated rows each give their pieces;
    extra columns are ignored; an empty table gives no rows.
    """
    texts, names_of = _texts_and_names(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column(0).to_pylist(), names_of(batch)
            rows = [(i, FIELDS[k], x.begin, x.end - x.begin, x.kind, t[x.begin:x.end])
                    for k in (0, 1) for i, t, n in zip(ids, batch.column(1 + k).to_pylist(), names) if t for x in find(t, n)]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["memory_id", "field", "begin", "length", "pii_type", "pii_text"])

    return texts.where("memory_id is not null").mapInArrow(run, "memory_id bigint, field string, begin int, length int, pii_type string, pii_text string")


def redact_all(turns: DataFrame) -> DataFrame:
    """``memory_id, user_prompt, assistant_response, replaced`` of every row: the texts with placeholders, otherwise unchanged, and how many there are."""
    texts, names_of = _texts_and_names(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = names_of(batch)
            found = [[find(t, n) for t, n in zip(batch.column(k).to_pylist(), names)] for k in (1, 2)]
            texts = [pa.array([redact(t, x) for t, x in zip(batch.column(k + 1).to_pylist(), found[k])], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *texts, pa.array([len(a) + len(b) for a, b in zip(*found)], pa.int32())], names=["memory_id", *FIELDS, "replaced"])

    return texts.mapInArrow(run, "memory_id bigint, user_prompt string, assistant_response string, replaced int")
