"""Refusals by a naive Bayes classifier over the word n-grams of a sentence.

Two classes are known from a bounded set of seed sentences in four languages:
sentences that decline, and asides that go with declining (whom to ask instead,
what else may be asked). They are compared with a background, the opening
sentences of all responses of the corpus. An n-gram that no seed holds counts
against a class, the n-grams of seeds count for it the more, the rarer they are
in the background. A response is a refusal if each of its sentences belongs to
one of the classes, and one declines. What is quoted is talked about, not said,
and does not count for a class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np

#: The seed sentences, all that the classes are fitted on.
DECLINES = """I'm sorry, but I can't help with that.
I'm sorry, but I cannot help with this request.
I am sorry, I can't assist with that request.
Sorry, I can't do that.
Sorry, this is not something I can help with.
This is not something I am able to do.
That is not something I can do for you.
I cannot comply with this request.
I can't answer that question.
I am unable to help with this.
I'm not able to assist with that.
I am not allowed to do this.
I won't do this.
I will not help with this request.
I must decline this request.
I have to decline.
I have to pass on this one.
I would rather not do this.
I'd prefer not to answer that.
Unfortunately I cannot help with that.
Unfortunately I have to refuse this request.
This goes against my guidelines.
That request goes against my policy.
This may conflict with my guidelines.
My instructions do not permit this.
My guidelines do not allow me to help with that.
There is nothing I can offer here.
I can't share this information.
I'm unable to provide an answer about this.
I must decline to work on this.
As an assistant I must decline.
My instructions do not permit me to discuss this or to work on that.
I can't discuss that.
I refuse to answer that.
Es tut mir leid, dabei kann ich nicht helfen.
Tut mir leid, das kann ich nicht machen.
Dazu darf ich leider keine Auskunft geben.
Dazu kann ich leider nichts sagen.
Leider kann ich diese Anfrage nicht bearbeiten.
Ich kann dir dabei leider nicht helfen.
Ich darf diese Frage nicht beantworten.
Das kann ich nicht beantworten.
Ich muss diese Anfrage ablehnen.
Das muss ich leider ablehnen.
Das verstößt gegen meine Richtlinien.
Das ist mir nicht gestattet.
Bei dieser Aufgabe kann ich nicht weiterhelfen.
Je suis désolé, je ne peux pas vous aider pour cette demande.
Désolé, je ne peux pas faire cela.
Je ne peux pas répondre à cette question.
Il m'est impossible de répondre à cette demande.
Je ne suis pas autorisé à faire cela.
Je ne suis pas en mesure de vous aider.
Je dois refuser cette demande.
Je préfère ne pas répondre.
Cela va à l'encontre de mes consignes.
Cela ne m'est pas permis.
Cette demande dépasse ce qui m'est permis.
Lo siento, no puedo ayudar con esa petición.
Lo siento, no puedo hacer eso.
Lamento no poder ayudar con esto.
No me es posible responder a esa pregunta.
No puedo responder a esa pregunta.
No me está permitido hacer eso.
No estoy autorizado a responder.
Debo rechazar esta petición.
Tengo que negarme a hacerlo.
Va en contra de mis normas.
Prefiero no responder a eso."""
#: The seed sentences of asides.
ASIDES = """Please ask someone else.
Please ask someone on the other team instead.
Please contact the support team.
Please consult an expert.
If you have another question, feel free to ask.
If you have another question about something else, feel free to ask.
Let me know if there is anything else I can help with.
Is there anything else I can help you with?
You may ask someone on the team.
I hope you understand.
I apologize for the inconvenience.
Thank you for your understanding.
Bitte wende dich an das Team.
Bitte wenden Sie sich an den Support.
Bitte frag jemanden aus dem Team.
Wenn du eine andere Frage hast, frag gern.
Entschuldigung für die Umstände.
Adressez-vous à l'équipe.
Veuillez vous adresser à l'équipe.
Veuillez demander à quelqu'un d'autre.
N'hésitez pas à poser une autre question.
Merci de votre compréhension.
Por favor, consulta con el equipo.
Por favor, pregunta a otra persona.
Consulte con el equipo responsable.
Si tienes otra pregunta, puedes hacerla.
Gracias por tu comprensión."""
BUCKETS = 1 << 16
#: Occurrences that an n-gram no seed holds counts as, in a class of that many n-grams.
UNSEEN = 0.35
#: Nats that a sentence must have, as few sentences belong to a class.
PRIOR = 4.0

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]*[\"”“»]")
#: Paths, identifiers, numbers and code, each as one word.
_CODE = re.compile(r"`.*|.*`[.,;:!?]*|.*(?:[\w-][/_]|\w\.\w|[a-z][A-Z]|\(\)|\d).*")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[^\W\d_]")
#: What stands for quotes and for code.
_QUOTE, _NAME = " quotedwords ", "codename"


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if any(map(str.isalnum, s))]


def opening(text: str) -> str | None:
    """The first sentence of a text."""
    at = 0
    for m in _SENTENCE.finditer(text):
        if any(map(str.isalnum, s := text[at:m.start()])):
            return s
        at = m.end()
    return text[at:] if any(map(str.isalnum, text[at:])) else None


class _Hashes(dict):
    def __missing__(self, gram: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[gram] = zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS
        return h


_HASHES = _Hashes()


class _Words(dict):
    """The words of a token."""

    def __missing__(self, token: str) -> list[str]:
        if len(self) > 1 << 17:
            self.clear()
        w = self[token] = [_NAME] if _CODE.fullmatch(token) else _TOKEN.findall(token.replace("’", "'").lower())
        return w


_WORDS = _Words()


def grams(sentence: str) -> list[int]:
    """Hashed words, pairs and triples of words."""
    w = ["<"]
    for token in _QUOTED.sub(_QUOTE, sentence).split():
        w += _WORDS[token]
    w.append(">")
    return [_HASHES[g] for g in (*w[1:-1], *map(" ".join, zip(w, w[1:])), *map(" ".join, zip(w, w[1:], w[2:])))]


def background(openings: Iterable[str | None]) -> np.ndarray:
    """Counts of the n-grams of opening sentences."""
    all_ = [h for s in openings if s for h in grams(s)]
    return np.bincount(np.array(all_, np.int64), minlength=BUCKETS).astype(float)


def fit(counts: np.ndarray) -> np.ndarray:
    """Log odds of each n-gram for the two classes against the background."""
    share = (counts + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    out = np.zeros((BUCKETS, 2), np.float32)
    for k, seeds in enumerate((DECLINES, ASIDES)):
        own = np.bincount([h for s in seeds.splitlines() for h in grams(s)], minlength=BUCKETS)
        n = own.sum()
        out[:, k] = np.log((own / share + UNSEEN * n) / (n + UNSEEN * n))
    return out


def is_refusal(model: np.ndarray, text: str, first: str | None = None) -> bool:
    """Whether every sentence declines or is an aside, and one declines."""
    first = opening(text) if first is None else first
    if not first or model[grams(first)].sum(axis=0).max() <= PRIOR:
        return False
    scores = np.array([model[grams(s)].sum(axis=0) for s in sentences(text)])
    return bool((scores.max(axis=1) > PRIOR).all() and (scores[:, 0] > PRIOR).any())
