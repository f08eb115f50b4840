"""Personal information in free text: found, typed and replaced by placeholders.

High-recall generators propose overlapping spans of five kinds. Boosted trees, one model a kind,
score each span by its format and by what surrounds it; thresholds are calibrated on labelled
texts kept out of the fit. Of overlapping spans the likeliest stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placeloom.llm.boosting import BoostedTrees
from placeloom.llm.pii_training import labelled

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelled texts made up to fit on, and to calibrate on; bounds of all training.
FIT_TEXTS, CALIBRATE_TEXTS = 3_500, 1_000

# Forms that the generators look for.
_WAYS = "Street|Road|Lane|Avenue|Drive|Terrace|Place|Court|Crescent|Boulevard|Square|Close|Way|Strs?|St|Rd|Ln|La|Ave|Av|Dr|Drv|Ter|Tce|Pl|Ct|Crt|Cres|Cr|Blvd|Bvd|Boul|Bd"
_FR = "rue|avenue|av|ave|chemin|che?m?|place|pl|impasse|imp|bd|boulevard|boul|quai|cours|allée|r"
_ES = r"Calle|C/|C\.|Cl\.?|Avenida|Avda?\.?|Av\.?|Plaza|Pl\.?|Pza\.?|Plza\.?|P\.|Paseo|Pso\.?|Camino|Cno\.?|Cmno\.?"
_DE = r"stra(?:ß|ss)e|str\.?|weg|wg\.?|gasse|gss\.?|g\.|platz|pltz\.?|pl\.|allee|al\.?"
_CAP = r"[A-ZÀ-ÖØ-Þ]"
_PART = r"von der|van der|van den|de la|von|van|der|den|del|della|de|di|da|du|zu|ter|dos|le"
_WORD = rf"{_CAP}[^\W\d_]*(?:['’-][^\W\d_]+)*"

_ENDING = re.compile(rf"(?:{_DE}|Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee) \d{{1,6}}[A-Za-z ]*$", re.I)
_STOP = frozenset(" \t\r\n@<>()[]{}\"',;:|=/\\`")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_SPELT = re.compile(r"(?<![\w.+'’-])([\w.+'’-]+)( ?[\[({] ?(?:at|AT|At) ?[\])}] ?| (?:at|AT) )([\w-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )[\w-]+)+)")
_SPELT_SIGNS = (" dot ", " DOT ", "[dot]", "[DOT]", "(dot)", "(DOT)", "{dot}", "(at)", "(AT)", "[at]", "[AT]", "{at}", "[ at ", "( at ")
_NUMBER = re.compile(r"(?:(?<![\w#@&.-])|(?<=^[-+]))[+(]?\d(?:\d|[ ./-](?=[\d(])|\)[ .-]?(?=\d)|\((?=\d)){6,}(?<=\d)(?![\w@])", re.M)
_LETTERED = re.compile(r"(?<![\w-])[A-Z]{1,2} ?\d{2}(?: ?\d){4,6}(?: ?[A-Z])?(?!\w)")
_ADDRESS = (
    re.compile(rf"(?<![\w.,/-])\d{{1,6}}(?: ?[A-Za-z])?,? (?:{_WORD}\.? ){{1,4}}(?:{_WAYS})\b(?! *[=(:{{])"),
    re.compile(rf"(?<![\w.,/-])\d{{1,6}}(?: ?[A-Za-z]|(?: bis| ter))?,? (?:{_FR})\.? (?:de la |de l['’]|des |de |du |d['’])?{_WORD}"),
    re.compile(rf"(?<![\w-]){_CAP}[^\W\d_]{{2,}}(?:-[^\W\d_]+)*\.?(?: (?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee))? \d{{1,6}}(?:[A-Za-z]| [A-Z])?(?!\w)"),
    re.compile(rf"(?<!\w)(?:{_ES}) ?(?:de la |de los |del |de )?{_WORD}(?: {_WORD})?,? \d{{1,6}}(?: ?[A-Za-z])?(?!\w)"),
)
_RUN = re.compile(rf"(?<![\w@/.]){_CAP}(?:\.|[^\W\d_]*(?:['’-][^\W\d_]+)*)(?:,? (?:(?:{_PART}) )?{_CAP}(?:\.(?= )|[^\W\d_]*(?:['’-][^\W\d_]+)*))+(?![\w@/(])")
_PIECE = re.compile(rf"(?:(?:{_PART}) )?({_CAP}(?:\.|[^\W\d_]*(?:['’-][^\W\d_]+)*))(,?)")
_DIGITS = re.compile(r"\d+")
_FILES = set("png jpg jpeg gif svg py js ts go rs md json yaml yml toml txt lock sh sql css html tar gz zip log csv git".split())
_EDGE = {c: i + 3 for i, c in enumerate("<>()[]{}\"'`,;:|/\\=#-+*.@_ \t")}


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold().replace("ø", "o")) if c.isalnum())


def _edge(text: str, at: int) -> int:
    """Class of the character at a place: 0 outside, 1 line break, 2 letter, others by sign, 40 digit, 41 any other."""
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c in "\r\n" else 40 if c.isdigit() else 2 if c.isalpha() else _EDGE.get(c, 41)


Candidate = tuple[str, int, int]


def propose(text: str) -> list[Candidate]:
    """Spans of a text that may be personal information, overlapping ones included."""
    out: list[Candidate] = []
    at = text.find("@")
    while at >= 0:
        if text[at + 1 : at + 2] not in ("@", " ", ""):
            left, right = at, _HOST.match(text, at + 1)
            if right and "." in right[0]:
                while left > 0 and text[left - 1] not in _STOP:
                    left -= 1
                if left < at:
                    out.append(("email", left, right.end()))
        at = text.find("@", at + (2 if text[at + 1 : at + 2] == "@" else 1))
    if any(x in text for x in _SPELT_SIGNS):
        out += [("email", m.start(), m.end()) for m in _SPELT.finditer(text)]
    for m in _NUMBER.finditer(text):
        s = m[0]
        n = sum(map(str.isdigit, s))
        if n >= 8 and not (s[0] in "12" and s[4:5] == "-" and s[7:8] == "-"):
            start, end = m.start(), m.end()
            if s[0] == "(" and ")" not in s:
                start += 1
            out.append(("phone", start, end))
            if n in (8, 9) and "." not in s and "/" not in s:
                out.append(("id_number", start, end))
    out += [("id_number", m.start(), m.end()) for m in _LETTERED.finditer(text)]
    for i, p in enumerate(_ADDRESS):
        out += [("address", m.start(), m.end()) for m in p.finditer(text) if i != 2 or _ENDING.search(m[0])]
    for m in _RUN.finditer(text):
        pieces = [(p.start(), p.end(1), p[1], p[2], p.start(1)) for p in _PIECE.finditer(text, m.start(), m.end())]
        for i in range(len(pieces)):
            if pieces[i][2].endswith(".") and len(pieces[i][2]) > 2:
                continue
            # every stretch of up to five pieces; longer ones from where a run begins and to where it ends, so that a line in capitals stays linear
            for j in [*range(i + 1, len(pieces) if i == 0 else min(i + 5, len(pieces))), *range(max(i + 5, len(pieces) - 1), len(pieces) if i else 0)]:
                commas = sum(1 for k in range(i, j) if pieces[k][3])
                last = pieces[j][2]
                if len(last) > 1 and not last.endswith(".") and (not commas or (commas == 1 and j == i + 1)):
                    # a particle before the first piece is not part of the name
                    out.append(("name", pieces[i][4], pieces[j][1]))
    return out


def _before(text: str, at: int) -> str:
    """Word in front of a place on its line, with the sign it ends in."""
    m = re.search(r"([^\W\d_][\w.-]*|[#*/+-]+)?([\s\"'(<:=,|.]*)$", text[max(0, at - 30, text.rfind("\n", 0, at) + 1) : at])
    return (m[1] or "").lower().strip(".") if m else ""


def _after(text: str, at: int) -> str:
    m = re.match(r"[\s\"'),;:]*([^\W\d_][\w-]*|[<|/])?", text[at : at + 30].split("\n", 1)[0])
    return (m[1] or "").lower() if m else ""


def _label(text: str, at: int) -> str:
    """First word of the line."""
    start = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
    m = re.match(r"[-+\s]*([^\W\d_][^\W\d_-]*)", text[start : min(at, start + 40)])
    return m[1].lower() if m else ""


def _emailed(text: str, start: int, end: int, words: list[str]) -> tuple[int, int]:
    """Whether an address in angle brackets follows, and whether a nearby one is made of the name."""
    near = text[end : end + 90].split("\n", 1)[0]
    follows = int(bool(re.match(r"\s?<[^<>\s]+@", near)))
    m = re.search(r"([\w.+-]+)\s?[\[(]?(?:@|at\b|AT\b)", near)
    if not m:
        return follows, 0
    local, family = plain(m[1]), plain(words[-1])
    return follows, 1 + 2 * int(family[:5] in local) + int(plain(words[0])[:1] == local[:1])


def describe(text: str, c: Candidate, given: frozenset[str]) -> tuple[list[float], list[str]]:
    """Numbers on format and surroundings, and the words whose weight is learned."""
    kind, start, end = c
    s = text[start:end]
    words = [_before(text, start), _after(text, end), _label(text, start)]
    f: list[float] = [_edge(text, start - 1), _edge(text, end), len(s)]
    if kind == "name":
        parts = [p for p in re.split(r"[ ,]+", s) if p]
        caps = [p for p in parts if p[0].isupper()]
        follows, made = _emailed(text, start, end, caps)
        turned = int("," in s)
        first, last = (caps[-1], caps[0]) if turned else (caps[0], caps[-1])
        f += [
            len(caps), int(first in given), int(first.endswith(".")), sum(p.endswith(".") for p in caps), len(parts) - len(caps), int(last in given), turned, follows, made,
            int(any(p.isupper() and len(p) > 2 for p in caps)), len(last), len(first), _edge(text, start - 2), int(text[max(0, start - 8) : start].rstrip()[-1:].isalpha()), sum(p in given for p in caps),
        ]
        words += [first.lower(), last.lower()]
    elif kind in ("phone", "id_number"):
        groups = [len(g) for g in _DIGITS.findall(s)]
        seps = Counter(ch for ch in s if not ch.isalnum())
        n = sum(groups)
        first = _DIGITS.search(s)[0]
        f += [
            n, int(s[0] == "+"), int("(" in s), int("(0)" in s), len(groups), groups[0], groups[1] if len(groups) > 1 else 0, groups[-1], seps[" "], seps["."], seps["-"], seps["/"], int(first[0] == "0"), int(first[:2]),
            int(re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}", s) is not None), int(re.fullmatch(r"\d{2}-\d{5}-\d", s) is not None), int(re.fullmatch(r"\d{9}", s) is not None), int(len(set(seps) - set("()+")) > 1),
            int(re.match(r"(19|20)\d\d[-./]", s) is not None), int(re.fullmatch(r"[A-Z]{2}( ?\d\d){3} ?[A-D]", s) is not None), int(re.fullmatch(r"[A-Z]{1,2}\d{6,8}", s) is not None), int(s[0].isalpha()) + int(s[-1].isalpha()),
            int(re.search(r"\.\d{1,3}\.\d{1,3}\.", s) is not None), int(s.count("(") != s.count(")")),
        ]
    elif kind == "address":
        digits = _DIGITS.findall(s)
        words += [re.sub(r"[\d\s,]+[A-Za-z]?$|^\d+\s?[A-Za-z]?,?\s", "", s).split(" ")[0].lower()[:12], (re.findall(r"[^\W\d_]+\.?", s) or [""])[-1].lower()]
        f += [int(s[0].isdigit()), len(digits[0]), len(digits), s.count(" "), int("." in s), int("," in s), int(text[end : end + 2] == ", "), int(text[end : end + 9].strip(", ")[:5].isdigit())]
    else:
        local, _, host = s.partition("@")
        labels = host.split(".")
        tld = labels[-1].lower()
        f += [int("@" in s), int(tld.isalpha()), len(tld), len(labels), int(host[:1].isdigit()), int(local == "git"), int(tld in _FILES), int("://" in text[max(0, start - 60) : start].split("\n")[-1].split(" ")[-1]), int(" " in s), int(" dot " in s.lower() or "dot" in s.lower()), int("(" in s or "[" in s), len(local), int(re.search(r"\.\d", host) is not None)]
    return f, words


@dataclass
class Detector:
    """Fitted models, word weights and thresholds of every kind."""

    given: frozenset[str]
    weights: dict[str, list[dict[str, float]]] = field(default_factory=dict)
    models: dict[str, BoostedTrees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def table(self, kind: str, described: list[tuple[list[float], list[str]]]) -> np.ndarray:
        return np.array([[*f, *(w.get(x, 0.0) for w, x in zip(self.weights[kind], words))] for f, words in described], float)

    def score(self, texts: list[str]) -> list[list[tuple[float, Candidate]]]:
        """Scored candidates of each text."""
        by_kind: dict[str, list] = defaultdict(list)
        for i, text in enumerate(texts):
            for c in dict.fromkeys(propose(text)):
                by_kind[c[0]].append((i, c, describe(text, c, self.given)))
        out: list[list[tuple[float, Candidate]]] = [[] for _ in texts]
        for kind, rows in by_kind.items():
            for (i, c, _), p in zip(rows, self.models[kind].predict(self.table(kind, [r[2] for r in rows]))):
                out[i].append((float(p), c))
        return out

    def select(self, scored: list[tuple[float, Candidate]]) -> list[Candidate]:
        """Spans over their threshold, the likeliest first, none overlapping another; in order of place."""
        kept: list[Candidate] = []
        for p, c in sorted(scored, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
            if p >= self.thresholds[c[0]] and all(c[2] <= k[1] or c[1] >= k[2] for k in kept):
                kept.append(c)
        return sorted(kept, key=lambda c: c[1])

    def find(self, texts: list[str]) -> list[list[Candidate]]:
        return [self.select(s) for s in self.score(texts)]


@lru_cache(maxsize=4)
def train(given: frozenset[str], seed: int = 11) -> Detector:
    """Fit on ``FIT_TEXTS`` made-up texts; thresholds by the best F1 on ``CALIBRATE_TEXTS`` others."""
    detector = Detector(given)
    names = sorted(given)
    rows: dict[str, list] = defaultdict(list)
    for text, spans in labelled(names, FIT_TEXTS, seed):
        true = set(spans)
        for c in dict.fromkeys(propose(text)):
            rows[c[0]].append((describe(text, c, given), c in true))
    for kind in KINDS:
        own = rows[kind]
        y = np.array([t for _, t in own], float)
        slots = max((len(d[1]) for d, _ in own), default=0)
        detector.weights[kind] = []
        for k in range(slots):
            seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for (_, words), t in own:
                seen[words[k]][int(t)] += 1
            base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
            detector.weights[kind].append({w: float(np.log((b + 1) / (a + 1)) - base) for w, (a, b) in seen.items() if a + b >= 12})
        detector.models[kind] = BoostedTrees().fit(detector.table(kind, [d for d, _ in own]), y)
    points: dict[str, list[tuple[float, bool]]] = defaultdict(list)
    for text, spans in labelled(names, CALIBRATE_TEXTS, seed + 1):
        true = set(spans)
        for p, c in detector.score([text])[0]:
            points[c[0]].append((p, c in true))
    for kind in KINDS:
        best = (-1.0, 0.5)
        total = sum(t for _, t in points[kind])
        for threshold in np.linspace(0.1, 0.9, 33):
            over = [t for p, t in points[kind] if p >= threshold]
            f1 = 2 * sum(over) / max(1, len(over) + total)
            best = max(best, (round(f1, 4), -abs(threshold - 0.5), float(threshold)))
        detector.thresholds[kind] = best[2]
    return detector


def given_names(names: DataFrame, column: str, most: int = 100_000) -> frozenset[str]:
    """The known given names; a fixed list, refused where it is longer than ``most``."""
    rows = names.select(column).filter(f"{column} is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} given names")
    return frozenset(r[0] for r in rows)


def find_pii(documents: DataFrame, given: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, surface)``: each distinct piece of personal information in each text, as written.

    Texts are read whole, null and empty ones hold nothing, null ids are kept. Rows that repeat an id give
    their pieces once each. Kinds: email, phone, id_number, address, name. One pass, no shuffle but for
    removing repeats.
    """
    detector = train(given)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, kinds, surfaces = [], [], []
            for i, (text, spans) in enumerate(zip(texts, detector.find(texts))):
                for k, s in dict.fromkeys((k, text[a:b]) for k, a, b in spans):
                    rows.append(i)
                    kinds.append(k)
                    surfaces.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(surfaces, pa.string())], names=[id_col, "kind", "surface"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, kind string, surface string").distinct()


def redact(documents: DataFrame, given: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``, ``[NAME]`` in place of each occurrence.

    All else stays as it is; null stays null. No shuffle.
    """
    detector = train(given)
    kind = documents.schema[id_col].dataType.simpleString()

    def replace(text: str, spans: list[Candidate]) -> str:
        out, at = [], 0
        for k, a, b in spans:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [None if t is None else replace(t, s) for t, s in zip(texts, detector.find([t or "" for t in texts]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=[id_col, text_col])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string")
