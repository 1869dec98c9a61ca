"""Template residue and error pages by positive-unlabelled naive Bayes.

A document's prose (code fences, inline code and quoted lines left out) is cut
into passages.  Short records with an unmistakable sign of an error page, a
demand for scripts, filler or an unfilled placeholder are trusted positives; a
sample of all others is unlabelled.  Expectation-maximization fits a naive Bayes
model on both: the unlabelled passages' class is the hidden variable.  Every
passage of every document is then scored, and the scores are aggregated: one
placeholder in the prose is enough, while filler and messages must make up the
body, so that a notice above complete content is none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the training sample, drawn by a hash: documents looked through for trusted ones, and unlabelled documents.
TRUSTED_FROM, UNLABELLED = 20_000, 3_000
#: Characters of a trusted record at most; longer ones are no short records.
TRUSTED_CHARS = 1500
ITERATIONS = 8
#: Share of unlabelled passages that the model may hold for residue.
MOST_RESIDUE = 0.25
#: Words of a short record, and the share of the body that residue must be.
SHORT, BODY_SHARE = 60, 0.5

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
_INLINE = re.compile(r"``[^`]+``|`[^`\n]+`")
_CUT = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SETEXT = re.compile(r"(?m)^[^\n]*\n(?:={3,}|-{3,})[ \t]*$\n?")
#: What any placeholder, empty value, id or path contains; a cheap first look.
_SPECIAL = re.compile(r"[{}$%<>\[\]@/]|__|XX-|undefined|NaN|Invalid|null|None|nil|\d[0-9a-fA-F]{3}|[0-9a-fA-F]{7}\d")
_HEAD = re.compile(r"^\s*#{1,6}\s|^\s*(?:=+|-+|\*+)\s*$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s*)?")
_NAV = re.compile(r"^[^.!?]{0,120}(?:\s[|>›»·]\s)[^.!?]{0,120}$")

_ID = r"[A-Za-z][\w.\- ]{1,40}?"
#: Forms in which templates write what is to be filled in (fixed values).
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*[\w.|\-#/]+\s*\}}\}}|\$\{{\s*[\w.]+\s*\}}|#\{{\s*[\w.]+\s*\}}|%%\s*[\w.]+\s*%%|%\([\w.]+\)[sdrif]|<%=?\s*[\w.\-]+\s*%>|\{{%\s*[\w.\- ]+\s*%\}}|<<\s*[\w.\-]+\s*>>|"
    rf"<insert[ _\-]{_ID}>|\[\[\s*[\w.\-]+\s*\]\]|\[(?i:insert)\b[^\]\n]{{1,40}}\]|\[{_ID} (?i:to be (?:filled in|added|defined|done|completed))\]|\[(?i:your|enter|add) {_ID}\]|"
    rf"(?<![\w`])__(?!(?:init|main|name|call|str|repr|all|file|dict|doc|class|iter|next|enter|exit|len|new|del|get|set)__)[A-Za-z][\w.]*?__(?!\w)|@@\s*[\w.]+\s*@@|\bXX-[\w.\-]+?-XX\b|"
    rf"\{{\d+:[\w.]+\}}|(?<![\w{{$#%])\{{[A-Za-z_][\w.]{{1,30}}\}}(?!\}})|(?<![\w$])\$[A-Za-z][\w.]{{2,30}}\$(?![\w$])"
)
#: What programs print for values they do not have (fixed values).
EMPTY = re.compile(r"\[object Object\]|\bInvalid Date\b|(?<![\w'`\"])undefined(?![\w'`\"])|(?<![\w'`\"])NaN(?![\w'`\"])|\bNone \(None\)|\((?:null|None|undefined)\)|\b(?:by|for|to|from|Hello|Dear|Hi|Hallo|Bonjour|Hola) (?:null|None|nil)\b")
#: Unmistakable signs in short records (fixed values, several languages).
TRUSTED = re.compile(
    r"(?i)lorem ipsum|dolor sit|ipsum lorem|blindtext|texte de remplissage|texto de relleno|text goes here|placeholder (?:copy|text)|sample (?:paragraph|text)|content coming soon|write something|insert body|add your (?:description|text)|"
    r"\b(?:enable|activate|allow|unblock|turn on|switch on|activar?|aktivieren|activer|activez)\b.{0,40}\b(?:javascript|js|scripts?|scripting)\b|\b(?:javascript|js|scripts?|scripting)\b.{0,40}\b(?:disabled|blocked|required|switched off|is off|désactivé|deaktiviert|desactivado)|"
    r"(?:requires|without|run) (?:javascript|scripts)|<noscript>|\b(?:http|error|fehler|erreur|status)[ :]*(?:code[ :]*)?[45]\d\d\b|^\W*[45]\d\d\b [A-Z][a-z]+|(?:page|document|path|file|entry|resource).{0,40}(?:not found|could not be found|nicht gefunden|introuvable|no encontrad)|"
    r"internal server error|bad gateway|gateway time-?out|service unavailable|access denied|permission to (?:open|access)|rate limited|too many requests|down for maintenance|wartungsarbeiten|fatal error|stack trace|traceback \(most recent|uncaught exception|not a robot|checking your (?:connection|browser)|"
    r"session has expired|upstream connect error|nosuchkey|\"error\":\s*\{\"code\""
)


def prose(text: str) -> str:
    """The text without code fences, inline code, indented code, quoted lines, rules of tables and underlined headings.

    Rows of tables are passages of their cells; items of nested lists stay.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    if "\n===" in text or "\n---" in text:
        text = _SETEXT.sub("", text)
    if "\n>" in text or "\n|" in text or "\n " in text or "\n\t" in text or text[:1] in "> |\t":
        text = "\n".join(_cells(x) for x in text.split("\n") if not x.lstrip().startswith(">") and (not x.startswith(("    ", "\t")) or _LIST.match(x)))
    return text


def _cells(line: str) -> str:
    """A row of a table as its cells, one a line; any other line as it is."""
    if not line.lstrip().startswith("|"):
        return line
    return "" if re.fullmatch(r"[\s|:\-]*", line) else "\n".join(c.strip() for c in line.strip().strip("|").split("|"))


def passages(text: str) -> list[str]:
    return [p for p in map(str.strip, _CUT.split(prose(text))) if p]


def analyse(passage: str) -> tuple[set[str], int, bool]:
    """(kinds of words, number of words, has a hole or an empty value) of a passage.

    Words are in lower case; placeholders, empty values, ids, paths and numbers
    count by their kind.
    """
    kinds: list[str] = []
    hole = False
    if _SPECIAL.search(passage):
        for pattern, kind in ((EMPTY, "⟦empty⟧"), (PLACEHOLDER, "⟦hole⟧"), (_HEX, "⟦id⟧"), (_PATH, "⟦path⟧")):
            passage, n = pattern.subn(" ", passage)
            if n:
                kinds.append(kind)
                hole = hole or kind in ("⟦empty⟧", "⟦hole⟧")
    found = _WORD.findall(passage.lower())
    n = len(found) + len(kinds)
    return set(found).union(kinds), n, hole


_HEX = re.compile(r"\b(?=[a-fA-F]*\d)[0-9a-fA-F]{8,}\b")
_PATH = re.compile(r"(?<![\w:])/[\w.\-]+(?:/[\w.\-]+)+")


#: Words of sentences that speak of placeholders instead of having one left (fixed values, several languages).
ABOUT = re.compile(r"(?i)placeholder|template|templat|variable|syntax|interpolat|\brender|escap|\bregex|pattern|literal|mustache|jinja|handlebars|substitut|platzhalter|vorlage|modèle|gabarit|plantilla|marcador|\bprints?\b|\bwrites?\b|\bshows?\b|\bmeans?\b")


def is_body(passage: str, n: int) -> bool:
    """Does the passage count as body: no heading, menu, rule or single word?"""
    return n > 1 and not (_HEAD.match(passage) or (n < 12 and _NAV.match(passage)))


def trusted(ps: list[str]) -> bool:
    """Is this a short record with an unmistakable sign?"""
    n = sum(analyse(p)[1] for p in ps)
    return 0 < n <= SHORT and any(TRUSTED.search(p) or EMPTY.search(p) or PLACEHOLDER.search(p) for p in ps)


class Model:
    """Word log-odds of residue against content, and of words the sample doesn't have."""

    def __init__(self, weight: dict[str, float], unseen: float, prior: float):
        self.weight, self.unseen, self.prior = weight, unseen, prior

    def score(self, kinds: set[str]) -> float:
        """Log-odds that a passage of these words is residue."""
        get, unseen = self.weight.get, self.unseen
        return self.prior + sum([get(w, unseen) for w in kinds]) if kinds else 0.0


def fit(positive: list[str], unlabelled: list[str], iterations: int = ITERATIONS) -> Model:
    """Naive Bayes by expectation-maximization; positives stay positive."""
    rows = [analyse(p)[0] for p in positive] + [analyse(p)[0] for p in unlabelled]
    df = Counter(w for r in rows for w in r)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, k in df.items() if k > 1))}
    rare = len(vocabulary)  # words of one passage only stand for all that the sample doesn't have
    where = np.array([i for i, r in enumerate(rows) for _ in r], dtype=np.int64)
    what = np.array([vocabulary.get(w, rare) for r in rows for w in r], dtype=np.int64)
    n, k, p = len(rows), len(positive), rare + 1
    belief = np.r_[np.ones(k), np.zeros(n - k)]
    weight, prior = np.zeros(p), 0.0
    for step in range(iterations):
        pos = np.bincount(what, weights=belief[where], minlength=p) + 0.5
        neg = np.bincount(what, weights=1 - belief[where], minlength=p) + 0.5
        weight = np.clip(np.log(pos / pos.sum()) - np.log(neg / neg.sum()), -6, 6)
        share = min(MOST_RESIDUE, max(belief[k:].mean() if n > k else 0.0, 0.01))
        prior = math.log(share / (1 - share))
        odds = prior + np.bincount(where, weights=weight[what], minlength=n)
        belief[k:] = 1 / (1 + np.exp(-np.clip(odds[k:], -40, 40)))
        if step == 0:
            belief[k:] *= 0.9  # what looks like residue by the trusted records alone stays open
    return Model({w: float(weight[i]) for w, i in vocabulary.items()}, float(weight[rare]), prior)


def decide(model: Model, text: str) -> tuple[bool, str, float, int, int]:
    """(residue, reason, strongest score, residue words, content words) of a document."""
    best, bad, good, hole = -99.0, 0, 0, False
    for p in passages(text):
        kinds, n, empty = analyse(p)
        s = model.score(kinds)
        hole = hole or empty and (s > 0 or not ABOUT.search(p))
        if n > 1 and is_body(p, n):
            best = max(best, s)
            if s > 0:
                bad += n
            elif n > 4 or p[-1] in ".!?。":  # a few words without an end are a caption, not content
                good += n
    if hole:
        return True, "placeholder", best, bad, good
    body = bad > 0 and bad >= BODY_SHARE * (bad + good)
    return body, "message" if body else "", best, bad, good


def train(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of samples whose sizes don't grow with the corpus, chosen by a hash of the key."""
    docs = docs.where(F.length(F.trim(text)) > 0).select(key, text)
    n = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / (1 << 30)
    short = docs.where(draw < TRUSTED_FROM / n).where(F.length(text) < TRUSTED_CHARS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t for t in b.column(0).to_pylist() if trusted(passages(t))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    pos = short.select(F.col(text).alias("text")).mapInArrow(pick, "text string").toArrow().column("text").to_pylist()
    some = docs.where(draw < UNLABELLED / n).select(F.col(text).alias("text")).toArrow().column("text").to_pylist()
    positive = [p for t in sorted(pos) for p in passages(t) if is_body(p, analyse(p)[1])]
    unlabelled = [p for t in sorted(some) for ps in [passages(t)] if not trusted(ps) for p in ps]
    return fit(positive, unlabelled)


def scored(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, residue, reason, score, residue_words, content_words) of all documents with text.

    Null, empty and blank texts have no row.  A corpus without any trusted
    record has a model that holds nothing for a message; placeholders need none.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, key, text))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            rows = [decide(m, t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.bool_(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], [key, "residue", "reason", "score", "residue_words", "content_words"])

    some = docs.where(F.length(F.regexp_replace(text, r"[\s ]", "")) > 0).select(key, text)
    return some.mapInArrow(run, f"{key} {kind}, residue boolean, reason string, score double, residue_words int, content_words int")
