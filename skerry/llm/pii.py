"""Problem 2: personal information in free text, found by anchor expansion.

An Aho-Corasick automaton scans each Arrow batch as one string for at-signs,
spelled-out at-signs, identifier cues, street words and the names listed in
person_names, with the further surnames their stems and endings make up;
runs of digits are anchors too. A deterministic local parser
grows every anchor to a whole value, or rejects it. Python sees a batch at a
time and only touches rows near anchors.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ["EMAIL", "PHONE", "IDENTITY", "ADDRESS", "NAME"]
_SEP = "\x00"

_AT = r"\s?(?:@|[\[({<]\s?(?:at|ät|arobase|arroba)\s?[\])}>])\s?"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|point|punto|punt)\s?[\])}>]\s?)"
_LOCAL = re.compile(r"[^\W_](?:[\w.%+\-]*[\w+])?$")
_DOMAIN = re.compile(rf"{_AT}([^\W_](?:[\w\-]*\w)?(?:{_DOT}[^\W_](?:[\w\-]*\w)?)+)")
_WORDED = re.compile(r"([^\W_][\w.%+\-]*)\sat\s([\w\-]+(?:\sdot\s[\w\-]+)+)")

#: Whose number it is: a number in brackets after one of these and a noun.
_OWNERS = "my your his her their our mon ma votre notre son sa leur mein meine dein deine ihr ihre unser unsere mi su tu nuestro nuestra mio mia suo sua loro mijn uw jouw zijn haar".split()
_IDS = r"(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{2}-\d{7}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{1,3}\d{6,9}|\d{7,9}[A-Z]|[A-Z]\d{7}[A-Z]|\d{9,12})"
_ID_BRACKETS = re.compile(rf"\(({_IDS})\)")
_OWNER_BEFORE = re.compile(rf"(?<!\w)(?i:{'|'.join(_OWNERS)})\s[^\W\d_]+\s$")
#: Account numbers, which are neither phones nor identity numbers: international ones and cards, told by their check digits.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w])")
_USER_INFO = re.compile(r"[a-z][a-z0-9+.\-]*://[^\s/@]*$", re.I)
_ID_NEXT = re.compile(rf"[^\d\x00.;!?]{{0,40}}?(?<![\w-])({_IDS})(?![\w-])")
_EXT = r"(?:\s?(?:ext\.?|extension|x|poste|Durchwahl|DW|int\.)\s?\d{1,5})?"
_PHONE = re.compile(
    rf"(?:\+\d{{1,3}}(?:[\s.\-/]?\(?\d{{1,5}}\)?){{2,6}}?|\(\d{{2,4}}\)\s?\d{{3,5}}[\s.\-/]?\d{{3,4}}|1[-. ]\(?\d{{3}}\)?[-. ]\d{{3}}[-. ]\d{{4}}|\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}|\d{{10,11}}|0\d(?:[ .\-]\d{{2}}){{4}}|0\d{{2,4}}[/ \-]\d{{4,8}}(?:[ \-]\d{{2,4}})?|00\d{{2}}(?:[ .\-]\d{{1,5}}){{2,6}}){_EXT}(?![\w\-/]*\d|[ .\-]\d{{2,4}}(?!\d)(?![ ][A-Z]))"
)
#: Words before a number that make it a part, batch, order or invoice, or a date.
_NOT_PHONE = re.compile(r"(?i)\b(?:part|teil|pi[eè]ce|pieza|batch|charge|lot|lote|serial|seriennummer|order|bestellung|commande|pedido|invoice|rechnung|facture|factura|ordine|bestelling|onderdeel|pezzo|partij|partita|lotto)\s(?:no\.?\s|nr\.?\s|n°\s)?$")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*"
_TOWN = rf"(?:(?:Bad|Port|Saint|San|Santa|Sankt|St\.|New|Le|La|Los|Las|Den|Villa)\s)?{_CAP}(?:-{_CAP})*"
_NO_TOWN = r"(?!(?:Tel|Tél|Phone|Telefon|Fax|Mobil)\b)"
_UNIT = r"(?:,\s(?:bajo|ático|entlo\.?|\d{1,2}\s?º(?:\s[A-Z])?|\d{1,2}\s?[oO]\s[A-Z]|Apt\.?\s\d+|apt\.?\s\d+))?"
_END = rf"{_UNIT}(?:,\s(?:\d{{4,5}}(?:\s[A-Z]{{2}})?\s{_TOWN}|{_NO_TOWN}{_TOWN}(?!\w|\s[a-zß]+\s(?:Sie|hat|liegt)\b)))?"
_NO = r"\d{1,4}(?:\s?[a-zA-Z](?!\w))?"
_EN = re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit)\s\d+,\s)?{_NO}\s{_CAP}(?:\s{_CAP})?\s(?:Street|Road|Lane|Avenue|Ave\.|Ave|Crescent|Square|Drive|Terrace|Close|Court|Way|St\.|Rd\.)(?!\w)(?!\s[a-z]{{3,}}s(?:\s(?:and|or|were|are|have|had|will)\b|[,.])){_END}")
_FR = re.compile(rf"\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|impasse|place|chemin|quai|allée|route|cours)\s(?:(?:du|des|de\sla|de|d['’])\s?)?(?:l['’])?{_CAP}(?:[- ]{_CAP})?{_END}")
_DE = re.compile(rf"(?:(?:Am|An\sder|Im|In\sder|Zum|Zur)\s)?{_CAP}(?:-{_CAP})*(?<=\w)\s{_NO}{_END}")
_ES = re.compile(rf"(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Carrera|Camino|Via|Viale|Piazza|Corso)\s(?:(?:de\sla|del|de|della|di)\s)?{_CAP}(?:\s{_CAP})?,?\s(?:n[.º°]\s?)?{_NO}{_END}")
_DE_STREET = re.compile(rf"((?:(?:Am|An\sder|Im|In\sder|Zum|Zur)\s)?{_CAP}(?:-{_CAP})*?)$")
_HOUSE = re.compile(rf"\s{_NO}{_END}")

#: Titles and forms of address; fixed words, never part of a name.
TITLES = set("dear dr prof mr mrs ms miss sir madam herr frau m mme mlle monsieur madame cher chère chers sr sra srta señor señora don doña estimado estimada hola hello hi tag guten liebe lieber sehr geehrte geehrter signor signora dott sig egregio gentile caro cara heer mevrouw dhr mevr beste geachte ing the der die das le la el los las il lo de het by par von por da door an und et y and e en und present anwesend présents asistentes presenti aanwezig".split())
#: Words that announce a name.
CALLED = ["My name is", "Mein Name ist", "Ich heiße", "Je m'appelle", "Je m’appelle", "Me llamo", "Mi nombre es", "Mi chiamo", "Mijn naam is", "Ik heet"]
#: Words that announce a personal number.
ID_CUES = ["identity number", "identity card", "passport", "passeport", "pasaporte", "passaporto", "paspoort", "reisepass", "ausweisnummer", "personalausweis", "ausweis", "numéro d'identité", "numéro d’identité", "carte d'identité", "número de identidad", "documento de identidad", "numero d'identità", "carta d'identità", "identiteitsnummer", "social security", "sécurité sociale", "seguridad social", "sozialversicherungsnummer", "steuernummer", "steuer-id", "tax number", "tax id", "tax identification", "numéro fiscal", "número fiscal", "codice fiscale", "burgerservicenummer", "ssn", "dni", "nif", "nie"]
_STREET_EN = ["Street", "Road", "Lane", "Avenue", "Ave", "Crescent", "Square", "Drive", "Terrace", "Close", "Court"]
_STREET_FR = ["rue ", "avenue ", "boulevard ", "impasse ", "place ", "chemin ", "quai ", "allée "]
_STREET_ES = ["Calle ", "C/ ", "Avenida ", "Avda. ", "Plaza ", "Paseo ", "Via ", "Viale ", "Piazza ", "Corso "]
_STREET_DE = ["straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ufer", "straat", "laan", "plein"]


def surnames_of(listed: list[str], most: int = 100_000) -> set[str]:
    """The listed surnames and those made of their shared stems and endings.

    A stem (4 letters at least) or ending (3 at least) is shared if three
    listed surnames have it with different remainders. Raises beyond `most`
    combinations.
    """
    pre, suf = {}, {}
    for n in set(listed):
        for i in range(3, len(n) - 2):
            pre.setdefault(n[:i], set()).add(n[i:])
            suf.setdefault(n[i:], set()).add(n[:i])
    ends = {s for s, p in suf.items() if len(p) >= 5}
    stems = {p: s & ends for p, s in pre.items() if len(s & ends) >= 3}
    # Of stems that extend each other, the one with most endings says where the stem ends.
    best = {p for p, s in stems.items() if not any((q.startswith(p) or p.startswith(q)) and q != p and (len(t), len(q)) > (len(s), len(p)) for q, t in stems.items())}
    used = Counter(e for p in best for e in pre[p])
    ends = [e for e, n in used.items() if n >= 3]
    if len(best) * len(ends) > most:
        raise ValueError(f"more than {most} combinations of the stems and endings of surnames")
    return set(listed) | {p + e for p in best for e in ends}


def iban_valid(x: str) -> bool:
    """Whether an international account number passes its check modulo 97."""
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def card_valid(x: str) -> bool:
    """Whether a card number passes the check of alternately doubled digits."""
    d = [int(c) for c in x if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(2 * v - 9 * (v > 4) for v in d[1::2])) % 10 == 0


class Finder:
    """The automaton and its local parsers; built once per Python worker."""

    def __init__(self, given: list[str], surnames: list[str]) -> None:
        self.given = {x.lower() for x in given}
        self.surnames = {x.lower() for x in surnames_of(surnames)}
        self.auto = ahocorasick.Automaton()
        put = lambda w, kind: self.auto.add_word(w, (kind, len(w)))
        for w in ("@", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", "(arobase)", "[arobase]", "(arroba)", "[arroba]", "(ät)"):
            put(w, "at")
        put(" dot ", "dot")
        for w in ID_CUES:
            for v in {w, w.capitalize(), w[:1].upper() + w[1:], w.upper(), w.title(), w.replace(" id", " ID"), w.capitalize().replace(" id", " ID")}:
                put(v, "id")
        for kind, words in (("en", _STREET_EN), ("fr", _STREET_FR), ("es", _STREET_ES), ("de", _STREET_DE)):
            for w in words:
                put(w, kind)
        for w in self.surnames:
            for v in {w.capitalize(), w.upper()}:
                put(v, "name")
        for w in CALLED:
            put(w, "called")
        self.auto.make_automaton()

    def spans(self, big: str) -> list[tuple[int, int, int]]:
        """Values as (type's place in TYPES, start, end), without overlaps, in order."""
        raw: list[tuple[int, int, int]] = []
        for end, (kind, n) in self.auto.iter(big):
            found = getattr(self, "_" + kind)(big, end + 1 - n, end + 1)
            if found:
                raw.append(found)
        raw += self._phones(big)
        raw += [(2, m.start(1), m.end(1)) for m in _ID_BRACKETS.finditer(big) if _OWNER_BEFORE.search(big[max(0, m.start() - 60) : m.start()])]
        raw = sorted(set(raw), key=lambda x: (_RANK[x[0]], x[1] - x[2], x[1]))
        taken: list[tuple[int, int, int]] = []
        starts: list[int] = []
        for x in raw:
            i = bisect_right(starts, x[1])
            if (i and taken[i - 1][2] > x[1]) or (i < len(taken) and taken[i][1] < x[2]):
                continue
            taken.insert(i, x)
            starts.insert(i, x[1])
        return taken

    def _at(self, t: str, s: int, e: int):
        while s and t[s - 1] in " \n":
            s -= 1
            if e - s > 12:
                return None
        m = _DOMAIN.match(t, s)
        if not m:
            return None
        start = s
        while start and (t[start - 1].isalnum() or t[start - 1] in "_.%+-"):
            start -= 1
        left = _LOCAL.search(t[start:s])
        # The user and password of an address with a scheme are no mail address.
        if not left or (start and t[start - 1] in ":/" and _USER_INFO.search(t[max(0, t.rfind(" ", 0, start), t.rfind("\n", 0, start), t.rfind(_SEP, 0, start)) : s])):
            return None
        return (0, s - len(left.group(0)), m.end())

    def _dot(self, t: str, s: int, e: int):
        at = max(0, s - 90, t.rfind(_SEP, 0, s) + 1)
        for m in _WORDED.finditer(t, at, min(len(t), e + 60)):
            if m.start() < s < m.end():
                return (0, m.start(), m.end())
        return None

    def _id(self, t: str, s: int, e: int):
        if s and t[s - 1].isalpha():
            return None
        m = _ID_NEXT.match(t, e)
        return (2, m.start(1), m.end(1)) if m else None

    def _around(self, rx: re.Pattern, t: str, s: int, e: int, back: int):
        at = max(0, s - back, t.rfind(_SEP, 0, s) + 1)
        for m in rx.finditer(t, at, e + 90):
            if m.start() > s:
                return None
            if m.end() >= e and not (m.start() and t[m.start() - 1].isalnum()):
                return (3, m.start(), m.end())
        return None

    def _en(self, t: str, s: int, e: int):
        return None if t[e : e + 1].isalpha() else self._around(_EN, t, s, e, 48)

    def _fr(self, t: str, s: int, e: int):
        return None if s and t[s - 1].isalnum() else self._around(_FR, t, s, e, 12)

    def _es(self, t: str, s: int, e: int):
        m = None if s and t[s - 1].isalnum() else _ES.match(t, s)
        return (3, m.start(), m.end()) if m else None

    def _de(self, t: str, s: int, e: int):
        m = _HOUSE.match(t, e)
        if not m:
            return None
        left = _DE_STREET.search(t[max(0, s - 40) : s])
        if not left or len(left.group(1)) < 2:
            return None
        start = s - len(left.group(1))
        return None if start and t[start - 1].isalnum() else (3, start, m.end())

    def _phones(self, t: str):
        a = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
        at = np.flatnonzero((a >= 48) & (a <= 57))
        if not len(at):
            return
        cut = np.flatnonzero(np.diff(at) > 3)
        first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
        many = last - first >= 8
        accounts = []
        for i, j in zip(at[first[many]].tolist(), at[last[many]].tolist()):
            accounts += [m.span() for m in _CARD.finditer(t, i, j + 1) if card_valid(m.group(0))]
            accounts += [m.span() for m in _IBAN.finditer(t, max(0, i - 8), j + 8) if iban_valid(m.group(0))]
        accounts.sort()
        begins = [a for a, _ in accounts]
        for i, j in zip(at[first[many]].tolist(), at[last[many]].tolist()):
            p = i
            while p <= j:
                s = p
                if s and t[s - 1] == "(":
                    s -= 1
                if s and t[s - 1] == "+":
                    s -= 1
                before = t[s - 1] if s else " "
                m = None if before.isalnum() or before in "-/_.@+" else _PHONE.match(t, s)
                if not m and s < p:
                    s = p
                    m = _PHONE.match(t, s)
                k = bisect_right(begins, m.end() - 1) if m else 0
                if m and k and accounts[k - 1][1] > s:
                    p = max(p + 1, accounts[k - 1][1])
                    continue
                if m and 9 <= sum(c.isdigit() for c in m.group(0)) <= 20 and not _NOT_PHONE.search(t[max(0, s - 24) : s]):
                    yield (1, s, m.end())
                    p = m.end()
                    continue
                while p <= j and t[p].isdigit():
                    p += 1
                while p <= j and not t[p].isdigit():
                    p += 1

    def _first_name(self, w: str) -> bool:
        """A listed given name, initials, or a capitalised word that is no title."""
        if re.fullmatch(r"(?:[A-ZÀ-Þ]\.[- ]?)+", w):
            return True
        low = w.lower().rstrip(".")
        return bool(re.fullmatch(r"[A-ZÀ-Þ][\w'’\-]+", w)) and low not in TITLES and low not in self.surnames

    def _name(self, t: str, s: int, e: int):
        before, after = t[s - 1] if s else " ", t[e : e + 1]
        if before.isalnum() or before in "@._+" or after.isalnum() or after in "@_+" or (before == "-" and s > 1 and t[s - 2].isalnum() and not self._is_surname(t, s - 1)):
            return None
        if before == "-" and s > 1 and t[s - 2].isalnum():
            return None  # grown from the first part
        if after == "-":
            m = re.compile(r"-([A-ZÀ-Þ][\w]+)").match(t, e)
            if m and m.group(1).lower() in self.surnames:
                e = m.end()
        start, words = s, []
        while len(words) < 4:
            m = _WORD_BEFORE.search(t, max(0, start - 24), start)
            if not m:
                break
            w = m.group(1)
            if not self._first_name(w):
                break
            if words and w in ("M.", "D.") and (len(words) > 1 or words[0].endswith(".") or len(words[0]) > 2):
                break
            words.append(w)
            start = m.start(1)
            if w.lower() in self.given and not re.match(r"[A-ZÀ-Þ]\.", t[max(0, start - 3) : start].strip() or " "):
                break
        if words:
            return (4, start, e)
        m = _GIVEN_AFTER.match(t, e)
        if m and (m.group(1).lower() in self.given or self._first_name(m.group(1))) and m.group(1).lower() not in _NOT_GIVEN:
            return (4, s, m.end(1))
        return None

    def _is_surname(self, t: str, e: int) -> bool:
        m = re.search(r"[A-ZÀ-Þ]\w+$", t[max(0, e - 30) : e])
        return bool(m) and m.group(0).lower() in self.surnames

    def _called(self, t: str, s: int, e: int):
        m = _CALLED_NAME.match(t, e)
        return (4, m.start(1), m.end(1)) if m and not any(w.lower().rstrip(".") in TITLES for w in m.group(1).split()) else None


_RANK = {0: 0, 2: 1, 1: 2, 3: 3, 4: 4}
_WORD_BEFORE = re.compile(r"(?<![\w.@+\-])((?:[A-ZÀ-Þ]\.\s?)+|[A-ZÀ-Þ][\w'’\-]+\.?)\s$")
_GIVEN_AFTER = re.compile(r",\s((?:[A-ZÀ-Þ]\.\s?)*[A-ZÀ-Þ]\.|[A-ZÀ-Þ][\w'’\-]+)(?!\w)")
_CALLED_NAME = re.compile(r"\s([A-ZÀ-Þ][\w'’\-]+(?:\s[A-ZÀ-Þ]\.)?\s[A-ZÀ-Þ][\w'’\-]+)(?!\w)")
_NOT_GIVEN = set("the der die das le la el il de het we wir nous and und et y".split())

_finders: dict[int, Finder] = {}


def _finder(given: list[str], surnames: list[str]) -> Finder:
    key = hash((tuple(given), tuple(surnames)))
    if key not in _finders:
        _finders[key] = Finder(given, surnames)
    return _finders[key]


def _located(finder: Finder, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(row, type, start, end) in each text, in order."""
    big = _SEP.join(x.replace(_SEP, " ") for x in texts)
    starts = np.cumsum([0] + [len(x) + 1 for x in texts]).tolist()
    for kind, s, e in finder.spans(big):
        row = bisect_right(starts, s) - 1
        if e <= starts[row + 1] - 1:
            yield row, kind, s - starts[row], e - starts[row]


def _run(given: list[str], surnames: list[str], redact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, surnames)
        for b in batches:
            tables, ids, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            known = [i for i, x in enumerate(texts) if x is not None]
            hits = [(known[r], k, s, e) for r, k, s, e in _located(finder, [texts[i] for i in known])]
            if not redact:
                rows = pa.array([h[0] for h in hits], pa.int32())
                yield pa.RecordBatch.from_arrays([tables.take(rows), ids.take(rows), pa.array([TYPES[h[1]] for h in hits], pa.string()), pa.array([texts[h[0]][h[2] : h[3]] for h in hits], pa.string())], names=["record_table", "record_id", "entity_type", "pii_value"])
                continue
            by: dict[int, list] = {}
            for h in hits:
                by.setdefault(h[0], []).append(h)
            counts = [0] * len(texts)
            for i, own in by.items():
                out, at = [], 0
                for _, k, s, e in own:
                    out += [texts[i][at:s], f"[{TYPES[k]}]"]
                    at = e
                texts[i] = "".join([*out, texts[i][at:]])
                counts[i] = len(own)
            yield pa.RecordBatch.from_arrays([tables, ids, pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["record_table", "record_id", "content", "n_found"])

    return found


def _names(person_names: DataFrame, most: int = 20_000) -> tuple[list[str], list[str]]:
    rows = person_names.where("name is not null and length(name) > 1").select("name", "kind").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return sorted(r.name for r in rows if r.kind == "given"), sorted(r.name for r in rows if r.kind == "surname")


def find_pii(records: DataFrame, person_names: DataFrame) -> DataFrame:
    """Distinct values per record: (record_table, record_id, entity_type, pii_value).

    records has (record_table, record_id, content). Null and empty content
    has no values; repeated rows and repeated values count once; texts of any
    length are read whole; person_names is a short list (20,000 rows at most,
    else this raises), with none of them names are only found after words
    that announce one. Extra columns are ignored.
    """
    rows = records.select("record_table", "record_id", "content").where("content is not null")
    return rows.mapInArrow(_run(*_names(person_names), False), "record_table string, record_id string, entity_type string, pii_value string").distinct()


def redact_pii(records: DataFrame, person_names: DataFrame) -> DataFrame:
    """(record_table, record_id, content, n_found), content with `[TYPE]` for each value.

    One row per input row, repeated rows included; null content stays null.
    """
    rows = records.select("record_table", "record_id", "content")
    return rows.mapInArrow(_run(*_names(person_names), True), "record_table string, record_id string, content string, n_found int")


def records_of(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    one = lambda df, name: df.select(F.lit(name).alias("record_table"), F.col("id").cast("string").alias("record_id"), "content")
    return one(messages, "messages").unionByName(one(chunks, "chunks"))
