"""Problem 7: defects of question-answer pairs.

A conditional random field tags the clauses of an answer as answer, refusal,
echo, foreign, unfinished or courtesy; the tags' coverage gives the pair's
defect. It is trained here, on a bounded sample of the messages and without
any list of phrases: sound answers as they are and without their full stop,
cut at random places, given to questions of another language, or replaced by
the restyled question. What declines is told by closed classes of words
(speaker, negation, ability, speech, regret, the request itself): sampled
clauses in which many classes meet a negation are weak labels, clauses with
few are answers, and the field weighs the classes, their meetings and their
share of a clause. Languages come from character n-grams: the regression of
problem 10, trained on sampled messages, scores each distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import language
from skerry.llm.crf import Crf
from skerry.llm.turns import codes, fresh, in_order, role_of
from skerry.plans.shared import materialise

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished", "courtesy"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, COURTESY = range(6)

#: Function words, by which sampled messages get the labels that the language model is trained on.
FUNCTION_WORDS = {
    "en": "the of and to in is was are were be been for on with as by at from this that these it its not no yes if or but which who whom why when where how what does do did has have had will would can could may there their they you your i my we our under after before within until about once than then only very please days see an a",
    "fr": "le la les l un une des du de d et à au aux est sont a ont été être pour sur dans avec par ce cette ces il elle ils elles qui que quoi quand où comment pourquoi combien n ne pas non oui si ou mais se sa son ses leur leurs nous vous votre notre je j mon ma mes après avant sous sans depuis chez lors puisque parce car jours voir selon en y plus qu s c",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird wurde wurden werden hat haben für auf mit bei von vom zu zum zur im in an am aus nach vor seit bis über unter durch ohne nicht nein ja kein keine wer was wann wo wie warum welche welcher welches wenn weil denn dass sie er es ich wir ihr ihre mein meine noch sich tage siehe als auch",
    "es": "el la los las un una unos unas del de y o e a al es son era fue ha han ser para por con sin sobre en entre desde hasta según que quien qué quién cuándo dónde cómo cuántos cuántas no sí si pero porque ya se su sus lo le les nos usted yo mi mis tras antes después días véase este esta estos estas como más cada",
}
#: Closed classes of words, in four languages, that clauses which decline are made of.
CLASSES = {
    "self": "i me my mine myself we us our assistant ai bot chatbot je j moi mes mon ma m nous notre nos assistante ia modèle ich mir mich mein meine meiner meinem meinen wir uns unser unsere assistent assistentin ki sprachmodell yo mi mis mí nosotros nuestro nuestra asistente modelo puedo debo quiero tengo voy prefiero siento soy estoy podemos",
    "not": "not no never t cannot nothing none unable without neither nor outside beyond ne n pas non aucun aucune jamais rien sans ni hors impossible nicht kein keine keinen keinem keiner keinerlei nie niemals nichts ohne außerhalb unmöglich weder nunca nada ningún ninguna ninguno sin fuera imposible tampoco",
    "decline": "decline declines declined refuse refuses refused reject avoid skip omit withhold abstain refrain aside prohibited forbidden prevents refuser refuse décliner décline éviter évite abstenir abstiens omettre taire silence côté interdit interdite empêche ablehnen ablehne lehne verweigern verweigere weigere vermeiden überspringen auslassen beiseite schweigen verzichten verboten untersagt enthalte rechazar rechazo negarme niego declinar declino evitar omitir saltar abstengo abstenerme lado callar prohibido impide",
    "may": "can could able may allow allowed permit permitted let lets will won would d rather must have willing want wish prefer supposed position authorised authorized peux peut puis pouvoir pourrais saurais permet permettent permis autorisé autorisée veux souhaite voudrais dois doit préfère mesure droit capable possible kann können könnte darf dürfen erlaubt erlauben gestattet will möchte werde muss lieber lage imstande fähig befugt möglich puede podría permiten permite permitido quisiera condiciones capaz posible autorizado autorizada puedo debo quiero tengo voy prefiero podemos",
    "speak": "help assist answer answers answering respond response reply discuss discussing comment comments say speak talk tell share provide give given disclose details information advice explain address engage handle handled elaborate aider aide répondre réponse réponds commenter commentaire commentaires dire parler parle discuter donner donne donnée donnerai fournir fournis partager communiquer détails renseignements renseigner information informations expliquer traiter traite traitée aborder helfen hilfe antworten antwort beantworten kommentieren kommentar sagen sprechen reden besprechen geben gebe gegeben nennen mitteilen auskunft auskünfte einzelheiten angaben äußern äußert äußere erläutern eingehen bearbeiten behandeln behandelt behandle stellung ayudar ayuda ayudarle responder respuesta contestar comentar comentario comentarios decir hablar dar doy dará detalles proporcionar compartir informar información explicar tratar trata tramitar tramitarse entrar ofrecer facilitar",
    "regret": "sorry apologies apologise apologize unfortunately regret afraid désolé désolée malheureusement regrette navré navrée hélas pardon leid leider bedaure bedauere entschuldigung entschuldigen verzeihung verständnis siento lamento lamentablemente desgracia disculpe disculpas perdón desafortunadamente",
    "asked": "question questions request requests topic topics subject subjects matter query guidelines rules instructions scope demande sujet thème requête consignes règles cadre frage fragen anfrage thema anliegen richtlinien vorgaben regeln hierzu dazu darüber hierüber pregunta preguntas petición tema asunto consulta directrices normas reglas ámbito",
    "else": "else elsewhere someone ailleurs adressez jemand anderen wenden anderswo otra diríjase consulte",
    "thanks": "thank thanks merci danke dank gracias",
}
#: Words that point at what follows.
POINTING = set("this that these those your such cette ce cet ces votre vos diese dieser diesem diesen dieses ihre ihrer este esta esto estas estos ese esa su sus".split())
#: A request to answer in a language, by the language asked for.
ASKED = {
    "en": r"in english|en anglais|auf englisch|en inglés",
    "fr": r"in french|en français|auf französisch|en francés",
    "de": r"in german|en allemand|auf deutsch|en alemán",
    "es": r"in spanish|en espagnol|auf spanisch|en español",
}
_ASK = re.compile(r"answer|reply|respond|write|translat|répond|écri|tradui|antwort|schreib|übersetz|respond|contest|escrib|traduc")
_ASKED = {k: re.compile(v) for k, v in ASKED.items()}
_SEED = {w: [] for ws in FUNCTION_WORDS.values() for w in ws.split()}
for _i, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in set(_ws.split()):
        _SEED[_w].append(_i)
_MASK: dict[str, int] = {}
for _i, _ws in enumerate(CLASSES.values()):
    for _w in _ws.split():
        _MASK[_w] = _MASK.get(_w, 0) | 1 << _i
SELF, NOT, DECLINE, MAY, SPEAK, REGRET, ASKED_FOR, ELSE, THANKS = (1 << i for i in range(len(CLASSES)))
_TOKEN = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"(?<=[.!?…])\s+(?=[^a-zß-öø-ÿ\s])|\s*\n\s*")
_ITEM = re.compile(r"^(?:[-*•–]|\d{1,3}[.)]|[a-z]\))(?:\s+|$)")
_CLOSED = re.compile(r"[.!?…:][\"'»”)\]]*$")
_OPEN = re.compile(r"(?:[,;(\-–/]|\([^)]*)$")
_MAIL_END = re.compile(r"(?:@|[(\[]at[)\]])\s?\S+(?:\.|\s?[(\[]dot[)\]]\s?)\w{2,}$")
_HANGING = set("the a an of and or to in with for by at from that which as than under le la les un une des du de et ou à au aux avec pour par que qui dans sur der die das den dem ein eine einen einem einer und oder mit für auf von zu im in an am bei el los las unos unas del y o con para por en al su sus is are was were est sont ist sind es son wird werden has have hat ha".split())
#: A word that closes a sentence or a line.
_ENDS = re.compile(r"([^\W_]+)[^\w\n\x00]*?(?:[.!?…:][\"'»”)\]]*(?=[\s\x00])|(?=\n))")


@dataclass
class Settings:
    """Messages of each role that the field and the languages are trained on, at most, `chars` characters of each; `support` ends that make a last word complete.

    A clause with `sure` votes for a refusal is a weak label, one with `calm` at most an answer.
    """

    sample: int = 3000
    chars: int = 4000
    support: int = 2
    sure: int = 4
    calm: int = 1


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(text) if c and not c.isspace()]


def seed_language(text: str) -> int | None:
    """The language (place in FUNCTION_WORDS) that most function words of a text belong to, if clearly so."""
    n = [0.0] * len(FUNCTION_WORDS)
    for w in _TOKEN.findall(text.lower()):
        for i in _SEED.get(w, ()):
            n[i] += 1.0 / len(_SEED[w])
    best = max(range(len(n)), key=n.__getitem__)
    return best if n[best] >= 2 and sorted(n)[-2] <= 0.5 * n[best] else None


def tokens_of(text: str) -> list[str]:
    """The words as they stand, but for the first, whose capital says nothing."""
    w = _TOKEN.findall(text)
    return [w[0].lower() if not w[0].isupper() or len(w[0]) == 1 else w[0], *w[1:]] if w else w


_NONE = (0.0,) * len(FUNCTION_WORDS)


class Words:
    """How much each word speaks for each language, by the n-gram model; words seen lately are kept."""

    def __init__(self, model: language.Model | None, most: int = 300_000) -> None:
        self.model, self.most, self.seen = model, most, {}

    def learn(self, texts: list[str]) -> None:
        """Score the new words of some texts, all at once; words with a capital are mostly names and do not count."""
        if self.model is None:
            return
        new = {w for t in texts for c in clauses(t) for w in tokens_of(c) if w not in self.seen and w.islower()}
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
        new = sorted(new)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            p = np.exp(self.model.log_probs(some))[:, [language.CODES.index(k) for k in FUNCTION_WORDS]]
            # A word that several languages may have says nothing.
            p = np.where(p >= 0.6, p, 0.0)
            # Words of two or three letters have few n-grams; those that label the sample are known.
            for i, w in enumerate(some):
                if w in _SEED:
                    p[i] = [float(k in _SEED[w]) / len(_SEED[w]) for k in range(len(FUNCTION_WORDS))]
            self.seen.update(zip(some, map(tuple, p.tolist())))

    def languages(self, words: list[str]) -> list[float]:
        rows = [v for v in map(self.seen.get, words) if v is not None and v != _NONE]
        return [sum(k) for k in zip(*rows)] if rows else [0.0] * len(FUNCTION_WORDS)


def language_model(texts: list[str], s: Settings) -> language.Model | None:
    """The n-gram regression of problem 10, trained on the words of messages whose function words are of one language."""
    seen: dict[str, Counter] = {}
    for t in texts:
        k = seed_language(t)
        if k is not None:
            for w in {w for c in clauses(t) for w in tokens_of(c)}:
                if w.islower():
                    seen.setdefault(w, Counter())[k] += 1
    # Words that several languages share teach nothing.
    words = [(w, c.most_common(1)[0][0], min(c.total(), 20)) for w, c in sorted(seen.items()) if c.most_common(1)[0][1] >= 0.9 * c.total()]
    if not words:
        return None
    pieces = [w for w, _, n in words for _ in range(n)]
    labels = [language.CODES.index(list(FUNCTION_WORDS)[k]) for _, k, n in words for _ in range(n)]
    return language.train(pieces, np.array(labels), np.ones(language.BUCKETS), language.Settings(noise=(0.0,)))


def _leading(n: list[float]) -> int:
    return n.index(max(n))


def _step(v: float, marks: tuple[float, ...]) -> list[float]:
    return [float(v >= m) for m in marks]


def votes(words: list[str]) -> tuple[int, int, float]:
    """How strongly the word classes of a clause speak for a refusal, the classes it has, and its share of such words."""
    has, hits, last = 0, 0, ""
    for w in words:
        m = _MASK.get(w, 0)
        if m:
            # The request itself must be pointed at: this question, your request.
            if m & ASKED_FOR and not (m & ~ASKED_FOR) and last not in POINTING and not w.startswith(("hier", "da")):
                m = 0
            has |= m
            hits += m != 0
        last = w
    neg = bool(has & (NOT | DECLINE))
    v = neg * (2 * bool(has & SELF) + bool(has & MAY) + 2 * bool(has & SPEAK) + 2 * bool(has & REGRET) + bool(has & ASKED_FOR) + bool(has & ELSE) + bool(has & DECLINE))
    return v, has, hits / max(len(words), 1)


def courteous(words: list[str], has: int, text: str) -> bool:
    """Thanks, or an offer of more help, without anything else."""
    if len(words) > 9:
        return False
    return bool(has & THANKS) and not has & (NOT | DECLINE) or (text.rstrip().endswith("?") and bool(has & (ELSE | SELF | SPEAK)) and len(words) <= 8 and not has & (NOT | DECLINE)) or (len(words) <= 5 and text.rstrip().endswith("?"))


_CUT, _UNSUPPORTED, _NUMBER, _LONE = 5, 9, 10, 14


def features(question: str, answer: str, cites: int, supported: bool, words_: Words) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(clauses, features) of an answer to a question, and the votes of each clause."""
    q_low = question.lower()
    qw = _TOKEN.findall(q_low)
    q_join, q_set = " " + " ".join(qw) + " ", set(qw)
    ql = words_.languages(tokens_of(question))
    # A question that several languages may have written allows each of them.
    allowed = {i for i, v in enumerate(ql) if v > 0.6 * max(ql)}
    if _ASK.search(q_low):
        allowed |= {i for i, rx in enumerate(_ASKED.values()) if rx.search(q_low)}
    cs = clauses(answer)
    raw = [tokens_of(c) for c in cs]
    words = [[x.lower() for x in w] for w in raw]
    langs = [words_.languages(w) for w in raw]
    whole = [sum(k) for k in zip(*langs)] or list(_NONE)

    def strange(n: list[float]) -> float:
        most = max(n)
        if not allowed or most <= 0:
            return 0.0
        own = max(n[i] for i in allowed)
        return most - own if _leading(n) not in allowed else -own

    far = strange(whole)
    seq = [w for ws in words for w in ws]
    subset = len(seq) > 0 and all(w in q_set for w in seq)
    rows, said, told = [], False, [votes(w) for w in words]
    for i, (c, w, n, (vote, has, dense)) in enumerate(zip(cs, words, langs, told)):
        last = i == len(cs) - 1
        bare = c.rstrip()
        dots = bare.endswith(("...", "…"))
        mail = last and bool(_MAIL_END.search(bare))
        closed = mail or (not dots and bool(_CLOSED.search(bare)))
        item = bool(_ITEM.match(c))
        text = " ".join(w)
        tail = text
        if ":" in c:
            tail = " ".join(_TOKEN.findall(c.partition(":")[2].lower()))
        within = bool(w) and w[0] in q_set and f" {text} " in q_join
        announced = not within and bool(tail) and tail != text and f" {tail} " in q_join and len(w) - len(tail.split()) <= 4
        share = sum(x in q_set for x in w) / len(w) if w else 0.0
        neg, polite = bool(has & (NOT | DECLINE)), courteous(w, has, c)
        k = strange(n)
        ends_low = w[-1] if w else ""
        cut = last and not closed
        hangs = cut and (ends_low in _HANGING or bool(_OPEN.search(bare)))
        number = cut and bare[-1:].isdigit()
        rows.append(
            [
                1.0, float(last), float(i == 0), float(item), float(closed), float(last and not closed), float(last and not closed and item),
                float(last and not closed and said), float(last and not closed and hangs), float(last and not closed and not supported and not number), float(last and not closed and number),
                *(float(last and not closed and not item) * x for x in _step(len(w), (3, 5, 8))), float(last and not closed and not item and not said and supported and not hangs), float(dots and last),
                float(last and item and len(w) == 0),
                float(within), float(announced), float(within and len(w) >= 4), float(subset), *_step(share, (0.5, 0.8, 0.95, 1.0)),
                *(float(bool(has & m)) for m in (SELF, MAY, SPEAK, REGRET, ASKED_FOR, ELSE)), float(neg), *(float(neg and bool(has & m)) for m in (SELF, MAY, SPEAK, REGRET, ASKED_FOR, ELSE)), float(bool(has & DECLINE)),
                *_step(vote, (2, 3, 4, 6)), *(float(neg) * x for x in _step(dense, (0.3, 0.5, 0.65))), float(neg and share < 0.2), float(polite),
                *_step(k, (0.5, 1, 2, 4)), *_step(-k, (0.5, 1, 2)), *_step(far, (0.5, 1, 2, 4)), *_step(-far, (0.5, 1, 2)),
                *_step(len(w), (1, 3, 6, 12)), float(cites > 0),
            ]
        )
        said = said or (closed and len(w) > 0)
    return np.array(rows), told


def last_word(answer: str) -> str | None:
    """The last word of an answer that ends without closing punctuation, in lower case."""
    if re.search(r"[.!?…:][\"'»”)\]]*\s*$", answer):
        return None
    w = _TOKEN.findall(answer.lower())
    return w[-1] if w else None


def train(questions: list[str], answers: list[str], ends: set[str], words_: Words, s: Settings, seed: int = 11) -> Crf:
    """Fit the field on sampled answers, as they are and with made-up defects; `ends` are words that clauses end with."""
    rng = np.random.default_rng(seed)
    words_.learn(questions + answers)
    by: dict[int, list[str]] = {i: [] for i in range(len(FUNCTION_WORDS))}
    for q in questions:
        n = words_.languages(tokens_of(q))
        if max(n) >= 2 and not (_ASK.search(q.lower()) and any(rx.search(q.lower()) for rx in _ASKED.values())):
            by[_leading(n)].append(q)
    x, y = [], []

    def put(q: str, a: str, tag: Callable[[int, int], int], voted: bool = True) -> None:
        w = last_word(a)
        f, told = features(q, a, int(rng.integers(0, 2)), w is None or w in ends, words_)
        tags = [tag(i, len(f)) for i in range(len(f))]
        if voted:
            # Clauses between the two limits have no weak label, and their answers are not trained on.
            if any(s.calm < v < s.sure for v, _, _ in told):
                return
            tags = [REFUSAL if v >= s.sure else COURTESY if t == ANSWER and courteous(_TOKEN.findall(c.lower()), has, c) else t for t, (v, has, _), c in zip(tags, told, clauses(a))]
        if len(f):
            x.append(f)
            y.append(np.array(tags))

    words_.learn([v for v in CLASSES.values()])
    of = {(k, i): [w for w in CLASSES[k].split() if (n := words_.languages([w]))[i] > 0] for k in CLASSES for i in by}

    def declining(lang: int, topic: list[str]) -> str:
        """A clause put together at random from the classes: many of them meet a negation, or the clause is little else."""
        neg = of["not" if rng.random() < 0.7 else "decline", lang]
        kinds = ["speak"] if (r := rng.random()) < 0.2 else ["self", "may"] if r < 0.4 else list(rng.permutation(["self", "may", "speak", "regret", "else"])[: int(rng.integers(3, 5))])
        some = [x[int(rng.integers(len(x)))] for x in [neg, *(of[k, lang] for k in kinds)] if x]
        about = topic[: 1 if len(kinds) == 1 else int(rng.integers(0, 4))]
        return " ".join([*rng.permutation(some), *about]).capitalize() + "."

    full = [b for b in by if by[b]]
    # A short text that several messages share is whole.
    shared = {a for a, k in Counter(answers).items() if k > 1 and len(a.split()) <= 5 and re.search(r"[^\W_]", a)}
    openings = [" ".join(a.split()[:2]) + ": " for a in sorted(set(answers)) if len(a.split()) > 3]
    for a in sorted(set(answers)):
        n = words_.languages(tokens_of(a))
        lang = _leading(n)
        if a in shared:
            for _ in range(12):
                any_ = by[lang] if by[lang] and max(n) > 0 else questions
                put(any_[int(rng.integers(len(any_)))] if any_ else "", a, lambda i, n: ANSWER)
        if max(n) < 0.5 or lang not in full:
            continue
        pick = lambda k: by[k][int(rng.integers(len(by[k])))]
        q = pick(lang)
        done = bool(re.search(r"[.!?]\s*$", a))
        if any(votes(_TOKEN.findall(c.lower()))[0] > s.calm for c in clauses(a)):
            # What declines, whole, twice; nothing else is made of it.
            if done:
                for _ in range(2):
                    put(pick(lang), a, lambda i, n: ANSWER)
            continue
        if done or "\n-" in a:
            put(q, a, lambda i, n: ANSWER)
            put(q, clauses(a)[0], lambda i, n: ANSWER)
        if done:
            if rng.random() < 0.25 and len(clauses(a)) == 1:
                put(q, a.rstrip().rstrip("."), lambda i, n: ANSWER)
            cut = a[: int(rng.integers(2 + len(a) // 3, max(len(a) - 1, 3 + len(a) // 3)))].rstrip()
            if 3 < len(cut) < len(a) - 1 and not re.search(r"[.!?]$", cut):
                put(q, cut + ("..." if rng.random() < 0.15 else ""), lambda i, n: UNFINISHED if i == n - 1 else ANSWER)
        if done and rng.random() < 0.8:
            topic = [w for w in _TOKEN.findall(q) if len(w) > 3]
            if of["not", lang] and of["speak", lang]:
                parts = [(declining(lang, topic), REFUSAL)]
                # Thanks before, or an offer after it.
                one = lambda k: [str(rng.choice(of[k, lang]))] if of[k, lang] else []
                filler = [str(w) for w in rng.permutation([w for w in a.split() if w.islower() and w.isalpha()][:12])[: int(rng.integers(0, 3))]]
                thanks = " ".join([*one("thanks"), *one("self"), *filler, *one("asked")][: int(rng.integers(1, 6))]).capitalize() + "."
                if rng.random() < 0.5 and of["thanks", lang]:
                    parts.insert(0, (thanks, COURTESY))
                if rng.random() < 0.2 and of["thanks", lang] and not any(votes(_TOKEN.findall(c.lower()))[0] for c in clauses(a)):
                    put(q, thanks + " " + a, lambda i, n: COURTESY if i == 0 else ANSWER, False)
                if rng.random() < 0.5 and (offer := [*one("else"), *one("speak"), *one("self")]):
                    parts.append((" ".join(offer).capitalize() + "?", COURTESY))
                put(q, " ".join(t for t, _ in parts), lambda i, n, p=parts: p[min(i, len(p) - 1)][1], False)
                # A negation and a word of another class within a long answer decline nothing.
                w = a.split()
                if len(w) >= 10:
                    for k in ("not", ("may", "speak", "else")[int(rng.integers(3))]):
                        if of[k, lang]:
                            w.insert(int(rng.integers(1, len(w))), of[k, lang][int(rng.integers(len(of[k, lang])))])
                    put(q, " ".join(w), lambda i, n: ANSWER, False)
        others = [k for k in full if k != lang]
        if others and (done or "\n-" in a):
            put(pick(others[int(rng.integers(len(others)))]), a, lambda i, n: FOREIGN, False)
        if rng.random() < 0.6:
            e = q
            r = rng.random()
            opening = openings[int(rng.integers(len(openings)))] if openings else ""
            e = e.upper() if r < 0.15 else e.lower() if r < 0.3 else e.replace(" ", "  ") if r < 0.4 else opening + e if r < 0.6 else f"{e} {e}" if r < 0.7 else e.rstrip(" ?") + "." if r < 0.8 else e
            put(q, e, lambda i, n: ECHO, False)
    width = features("a b", "c d.", 0, True, words_)[0].shape[1]
    return Crf(width, len(TAGS)).fit(x, y) if x else Crf(width, len(TAGS))


def defect(answer: str, tags: np.ndarray) -> str | None:
    """The pair's defect by the characters its clauses' tags cover."""
    cs = clauses(answer)
    size = np.zeros(len(TAGS))
    for c, t in zip(cs, tags):
        size[t] += len(c)
    told = size.sum() - size[COURTESY]
    if told <= 0:
        return None
    if size[ECHO] >= 0.9 * told:
        return "echo"
    if size[REFUSAL] >= 0.5 * told:
        return "refusal"
    if size[FOREIGN] >= 0.5 * told:
        return "language"
    if len(tags) and tags[-1] == UNFINISHED:
        return "truncated"
    return None


def judge(crf: Crf, words_: Words, rows: list[tuple[str, str | None, int]]) -> list[tuple[str | None, str | None, str | None]]:
    """(defect if the last word is a known end, defect if not, last word) of (question, answer, citations)."""
    out: list[tuple[str | None, str | None, str | None]] = [("empty", "empty", None)] * len(rows)
    todo, seqs = [], []
    words_.learn([t for q, a, _ in rows for t in (q, a) if t])
    for i, (q, a, n) in enumerate(rows):
        if a is None or not re.search(r"[^\W_]", a):
            continue
        w = last_word(a)
        todo.append((i, w))
        f = features(q or "", a, n, True, words_)[0]
        seqs.append(f)
        if w is not None:
            # Only two features of the last clause depend on whether its last word is known.
            f = f.copy()
            f[-1, _UNSUPPORTED], f[-1, _LONE] = f[-1, _CUT] - f[-1, _NUMBER], 0.0
            seqs.append(f)
    tags = iter(crf.decode(seqs)) if seqs else iter(())
    for i, w in todo:
        known = defect(rows[i][1], next(tags))
        out[i] = (known, known if w is None else defect(rows[i][1], next(tags)), w)
    return out


_OUT = "kind string, pid int, conv string, rank tinyint, message_id string, content string, cites int, known string, unknown string, word string"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int8(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Judgements of the pairs in a sorted partition, its first and last turn for the borders, and how often words end clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, model = shared.value
        words_, ends = Words(model), Counter()
        pid, last, prev, head = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keep, last = fresh(b, last)
            b = b.filter(pa.array(keep))
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            new = codes(b.column("conv"))
            at = np.flatnonzero((rank[1:] == 2) & (rank[:-1] == 1) & ~new[1:]) + 1
            content, ids, cites, conv = (b.column(k) for k in ("content", "id", "cites", "conv"))
            one = lambda i: (conv[i].as_py(), int(rank[i]), ids[i].as_py(), content[i].as_py(), cites[i].as_py())
            texts = content.to_pylist()
            ends.update(_ENDS.findall("\x00".join([t.lower() for t in texts if t] + [""])))
            pairs = list(zip([texts[i - 1] for i in at], [texts[i] for i in at], cites.take(pa.array(at)).to_pylist()))
            who = ids.take(pa.array(at)).to_pylist()
            first = one(0)
            if prev is not None and first[0] == prev[0] and first[1] == 2 and prev[1] == 1:
                pairs.append((prev[3], first[3], first[4]))
                who.append(first[2])
            out = [("pair", pid, None, None, m, None, None, *j) for m, j in zip(who, judge(crf, words_, pairs)) if j[0] or j[1]]
            if head is None:
                head = first
                out.append(("head", pid, *head, None, None, None))
            prev = one(b.num_rows - 1)
            yield _rows(out)
            if len(ends) > 200_000:
                yield _end_rows(ends, pid)
                ends = Counter()
        if prev is not None:
            yield _end_rows(ends, pid)
            yield _rows([("tail", pid, *prev, None, None, None)])

    return run


def _end_rows(ends: Counter, pid: int) -> pa.RecordBatch:
    return _rows([("end", pid, None, None, None, None, n, None, None, w) for w, n in ends.items()])


def _judged(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, model = shared.value
        words_ = Words(model)
        for b in batches:
            rows = list(zip(b.column("question").to_pylist(), b.column("content").to_pylist(), b.column("cites").to_pylist()))
            j = judge(crf, words_, rows)
            yield pa.RecordBatch.from_arrays([b.column("message_id"), *(pa.array([x[k] for x in j], pa.string()) for k in range(3))], names=["message_id", "known", "unknown", "word"])

    return run


def _sample(messages: DataFrame, role, s: Settings) -> tuple[list[str], list[str]]:
    rows = messages.where("content is not null and id is not null").select("id", "content", role("role").alias("r")).where("r in ('user', 'assistant')")
    n = {x.r: x.n for x in rows.groupBy("r").agg(F.count("*").alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("r") == r, F.lit(min(1.0, s.sample / k))) for r, k in sorted(n.items())], F.lit(0.0))
    got = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20)) & (F.length("content") <= s.chars)).limit(3 * s.sample).collect() if n else []
    got = sorted({(x.id, x.r, x.content) for x in got})
    got = [x[1:] for x in got]
    return [c for r, c in got if r == "user"], [c for r, c in got if r == "assistant"]


def pair_defects(messages: DataFrame, aliases: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(message_id, defect) of the assistant rows that directly follow a user row and have a defect.

    Order and roles are those of :mod:`skerry.llm.turns`; system rows, rows
    without created_at and unknown roles are left out, re-deliveries count
    once, null or blank answers are `empty`, a null question only rules out
    echo and language. The sample for training is at most settings.sample
    messages a role; all pairs are judged, and word counts are over all
    user and assistant messages. Empty tables give an empty result.
    """
    s = settings or Settings()
    role = role_of(aliases)
    questions, answers = _sample(messages, role, s)
    # Ends of the sampled answers' clauses only, a bounded set.
    known = {w for a in answers for c in clauses(a)[:-1] for w in _TOKEN.findall(c.lower())[-1:]} | {w for a in answers if last_word(a) is None for w in _TOKEN.findall(a.lower())[-1:]}
    model = language_model(questions + answers, s)
    shared = messages.sparkSession.sparkContext.broadcast((train(questions, answers, known, Words(model), s), model))
    # Links are followed through all rows before any is left out.
    turn = F.col("created_at").isNotNull() & F.col("id").isNotNull() & F.coalesce(role("role"), F.lit("")).isin("user", "assistant")
    rows = in_order(messages, role, [F.col("content"), F.coalesce(F.size("citations"), F.lit(0)).alias("cites")], turn)
    scanned = materialise(rows.mapInArrow(_scan(shared), _OUT), "judged")
    ends = scanned.where("kind = 'end'").groupBy("word").agg(F.sum("cites").alias("n"))
    # At most two rows a partition: each first turn with the last turn of the partition before.
    edges = scanned.where("kind in ('head', 'tail')")
    edges = edges.withColumn("tail_first", F.struct("pid", F.when(F.col("kind") == "head", 0).otherwise(1).alias("k")))
    order = Window.partitionBy(F.lit(1)).orderBy("tail_first")
    met = edges.select("kind", "conv", "rank", "message_id", "content", "cites", *(F.lag(c).over(order).alias(f"p_{c}") for c in ("kind", "conv", "rank", "content")))
    met = met.where("kind = 'head' and p_kind = 'tail' and conv = p_conv and rank = 2 and p_rank = 1").select("message_id", F.col("p_content").alias("question"), "content", "cites")
    border = met.mapInArrow(_judged(shared), "message_id string, known string, unknown string, word string")
    judged = scanned.where("kind = 'pair'").select("message_id", "known", "unknown", "word").unionByName(border)
    sure = judged.where("known <=> unknown").select("message_id", F.col("known").alias("defect"))
    open_ = judged.where("not (known <=> unknown)").join(ends.where(f"n >= {s.support}"), "word", "left")
    open_ = open_.select("message_id", F.when(F.col("n").isNotNull(), F.col("known")).otherwise(F.col("unknown")).alias("defect"))
    return sure.unionByName(open_).where("defect is not null")
