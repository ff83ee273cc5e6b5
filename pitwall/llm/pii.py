"""Personal data by rules and a semi-Markov conditional random field.

Rules find emails, IP addresses, card and phone numbers in their plain forms. The model
adds forms the rules miss. It scores whole candidate spans, not single words: a segment of
up to MAX_TOKENS tokens of a region gets a score for each kind from features of the whole
span and its neighbours, a dynamic programme over the region chooses boundaries and kinds
together, and weights are fitted by the likelihood over all segmentations. It learns from
what the rules find, from the same strings written in other ways, and from near misses.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, text_rows

#: In the order of results.
KINDS = ("email", "ip", "card", "phone")
OTHER = "other"

#: Most tokens of an entity, texts and regions of the fitted sample, passes over it, least posterior of an added span.
MAX_TOKENS = 8
SAMPLE = 1500
REGIONS = 900
PASSES = 10
CERTAIN = 0.9

# The plain forms.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Words that stand before or after an entity.
CUES = {
    "email": frozenset("mail email e-mail contact write courriel correo".split()),
    "ip": frozenset("ip ipv4 host server address addr".split()),
    "card": frozenset("card visa credit mastercard carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon telefono".split()),
}

_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]", re.IGNORECASE)
#: A word that joins the words around it.
_JOINT = re.compile(r"@|[(\[](?:at|dot)[)\]]", re.IGNORECASE)
_EDGE = ".,;:!?\"'<>{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            end = match.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain forms, by kind and start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    out += [
        ("ip", m.start(), m.end()) for m in _IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    ]
    for m in _CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


Token = tuple[str, int, int]


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    """Words without the punctuation around them, with their places."""
    out = []
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        word = m[0]
        left = len(word) - len(word.lstrip(_EDGE))
        word = word.strip(_EDGE)
        if word:
            out.append((word, m.start() + left, m.start() + left + len(word)))
    return out


def regions(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[list[Token], str, str]]:
    """Runs of tokens that may hold an entity, one token apart at most, with the words before and after.

    A run all of whose digits and signs the rules have explained is left out when `spans`
    are given.
    """
    found: list[tuple[int, int]] = []
    hot = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < hot:
            continue
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        hot = end
        if _JOINT.fullmatch(text[start:end]):
            around = tokens_of(text, max(0, start - 40), start), tokens_of(text, end, min(len(text), end + 40))
            start = around[0][-1][1] if around[0] else start
            end = around[1][0][2] if around[1] else end
        # One word between two triggers joins them, as in "name at host (dot) org".
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        elif found and len(text[found[-1][1] : start].split()) <= 1 and start - found[-1][1] <= 24:
            found[-1] = (found[-1][0], end)
        else:
            found.append((start, end))
    out = []
    for start, end in found:
        if spans and all(any(a <= m.start() < b for _, a, b in spans) for m in _TRIGGER.finditer(text, start, end)):
            continue
        before = tokens_of(text, max(0, start - 40), start)
        after = tokens_of(text, end, min(len(text), end + 40))
        tokens = tokens_of(text, start, end)
        # Long runs are cut, with as many tokens in common as an entity can have.
        for i in range(0, max(1, len(tokens) - MAX_TOKENS), 40):
            part = tokens[i : i + 40 + MAX_TOKENS]
            if part:
                left = tokens[i - 1][0] if i else (before[-1][0] if before else "")
                right = tokens[i + 40 + MAX_TOKENS][0] if len(tokens) > i + 40 + MAX_TOKENS else (after[0][0] if after else "")
                out.append((part, left.lower(), right.lower()))
    return out


def features(span: str, n_tokens: int, left: str, right: str) -> list[str]:
    """Names of the features of a whole span."""
    digits, letters = digits_of(span), sum(c.isalpha() for c in span)
    out = ["bias", f"tokens={min(n_tokens, MAX_TOKENS)}"]
    n = len(digits)
    bucket = next(b for b in (0, 3, 6, 7, 9, 11, 15, 19, 10**9) if n <= b)
    out.append(f"digits={bucket}{'+letters' if letters else ''}")
    parts = re.split(r"[^0-9]+", span.strip("()[]+"))
    if n >= 13:
        out.append(f"luhn={luhn(digits)},{16 <= n <= 19},{bool(letters)}")
        out.append(f"fours={all(len(p) == 4 for p in parts)}")
    if len(parts) == 4 and not letters and all(parts):
        out.append(f"quad={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    separators = "".join(sorted({"." if c == "." else "-" if c == "-" else "/" if c == "/" else "_" if c == " " else "(" if c in "()" else "[" if c in "[]" else ""
                                 for c in span if not c.isalnum() and c != "+"}))
    if n >= 4 and not letters:
        out.append(f"by={separators},{bucket}")
    if span[0] == "+" or span.startswith("00"):
        out.append(f"start={'+' if span[0] == '+' else '00'},{8 <= n <= 17 and not letters}")
    if span[0] == "(" and re.match(r"\([0-9]{2,5}\)", span):
        out.append("area")
    low = span.lower()
    at = re.search(r"@|[(\[]at[)\]]", low)
    if at:
        name, host = low[: at.start()].strip(), low[at.end() :].strip()
        host = re.sub(r"\s*[(\[]dot[)\]]\s*", ".", host)
        good = bool(re.fullmatch(r"[a-z0-9._%+-]+", name)) and bool(re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}", host))
        out.append(f"address={good}")
    if re.fullmatch(r"(?=.*[a-f])(?=.*[0-9])[0-9a-f]+", low):
        out.append("hex")
    for kind, cues in CUES.items():
        if left.strip("()[]:#") in cues:
            out.append(f"after {kind}")
        if right in cues:
            out.append(f"before {kind}")
    return out


class SemiMarkov:
    """Weights of (feature, kind), and inference over a region's segmentations."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights: dict[tuple[str, str], float] = defaultdict(float, weights or {})

    @staticmethod
    def candidates(tokens: list[Token], text_of, left: str, right: str) -> dict[tuple[int, int], list[str]]:
        """Features of each segment [i, j) that can be an entity: it begins and ends with a digit, sign or letter part of one."""
        out = {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                span = text_of(tokens[i][1], tokens[j - 1][2])
                if not _TRIGGER.search(span):
                    continue
                out[i, j] = features(
                    span, j - i, tokens[i - 1][0].lower() if i else left, tokens[j][0].lower() if j < len(tokens) else right
                )
        return out

    def score(self, names: list[str], kind: str) -> float:
        weights = self.weights
        return sum(weights[n, kind] for n in names if (n, kind) in weights)

    def segments(self, candidates: dict, n: int) -> dict[tuple[int, int, str], float]:
        """Scores of all segments. A token outside of entities is a segment of its own, of score 0."""
        out = {(i, i + 1, OTHER): 0.0 for i in range(n)}
        for (i, j), names in candidates.items():
            for kind in KINDS:
                out[i, j, kind] = self.score(names, kind)
        return out

    @staticmethod
    def forward(scores: dict, n: int) -> list[float]:
        ending = defaultdict(list)
        for (i, j, _), s in scores.items():
            ending[j].append((i, s))
        alpha = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            alpha[j] = _log_sum(alpha[i] + s for i, s in ending[j])
        return alpha

    def posteriors(self, scores: dict, n: int) -> dict[tuple[int, int, str], float]:
        alpha = self.forward(scores, n)
        back = {(n - j, n - i, k): s for (i, j, k), s in scores.items()}
        beta = self.forward(back, n)[::-1]
        return {(i, j, k): math.exp(alpha[i] + s + beta[j] - alpha[n]) for (i, j, k), s in scores.items()}

    @staticmethod
    def best(scores: dict, n: int) -> list[tuple[int, int, str]]:
        """The segmentation of highest score; of equal ones the first found by place and kind."""
        value, choice = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i, j, kind in sorted(scores, key=lambda x: (x[1], x[0], x[2])):
            if value[i] + scores[i, j, kind] > value[j]:
                value[j], choice[j] = value[i] + scores[i, j, kind], (i, j, kind)
        out, at = [], n
        while at:
            out.append(choice[at])
            at = choice[at][0]
        return out[::-1]

    def fit(self, examples: list[tuple[dict, int, list[tuple[int, int, str]]]], passes: int = PASSES, seed: int = 7) -> None:
        """Adagrad steps on the log-likelihood of the gold segmentations (candidates, tokens, entities)."""
        squares: dict[tuple[str, str], float] = defaultdict(float)
        order, shuffle = list(range(len(examples))), random.Random(seed)
        for _ in range(passes):
            shuffle.shuffle(order)
            for x in order:
                candidates, n, gold = examples[x]
                slope: dict[tuple[str, str], float] = defaultdict(float)
                for (i, j, kind), p in self.posteriors(self.segments(candidates, n), n).items():
                    if kind != OTHER and p > 1e-6:
                        for name in candidates[i, j]:
                            slope[name, kind] -= p
                for i, j, kind in gold:
                    for name in candidates.get((i, j), ()):
                        slope[name, kind] += 1
                for key, g in slope.items():
                    g -= 1e-3 * self.weights[key]
                    squares[key] += g * g
                    self.weights[key] += 0.5 * g / math.sqrt(squares[key] + 1e-8)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of the best segmentations that are certain enough and meet no span of the rules."""
        out = []
        for tokens, left, right in regions(text, base or [("", -1, -1)]):
            candidates = self.candidates(tokens, lambda a, b: text[a:b], left, right)
            scores = self.segments(candidates, len(tokens))
            chosen = [s for s in self.best(scores, len(tokens)) if s[2] != OTHER]
            if not chosen:
                continue
            sure = self.posteriors(scores, len(tokens))
            for i, j, kind in chosen:
                span = (kind, tokens[i][1], tokens[j - 1][2])
                if sure[i, j, kind] >= CERTAIN and not any(a < span[2] and span[1] < b for _, a, b in [*base, *out]):
                    out.append(span)
        return out


def _log_sum(values) -> float:
    values = list(values)
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def rewritten(kind: str, span: str, pick: random.Random) -> tuple[str, bool]:
    """The span written in another way, and whether it still is personal data."""
    digits = digits_of(span)
    if kind == "email":
        name, host = span.split("@", 1)
        dot = pick.choice([".", ".", " (dot) ", "[dot]"])
        at = pick.choice([" (at) ", "(at)", " [at] ", "[at]", " @ "])
        return name + at + host.replace(".", dot), True
    if kind == "ip":
        if pick.random() < 0.5:
            return span.replace(".", "[.]"), True
        return ".".join(str(int(p) + 256) for p in span.split(".")), False
    if kind == "card":
        way = pick.random()
        if way < 0.4:
            wrong = digits[:-1] + str((int(digits[-1]) + pick.randint(1, 9)) % 10)
            return wrong, False
        by = pick.choice([".", "/", "  ", " . "])
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4)), True
    way = pick.random()
    if way < 0.3:
        return "00" + digits, True
    if way < 0.6:
        return f"({digits[1:4]}) {digits[4:7]}-{digits[7:]}", True
    return digits, False


def example(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[dict, int, list[tuple[int, int, str]]]]:
    """Training examples of a text's regions with the given entities."""
    out = []
    for tokens, left, right in regions(text, []):
        starts, ends = {t[1]: i for i, t in enumerate(tokens)}, {t[2]: i + 1 for i, t in enumerate(tokens)}
        gold, at = [], -1
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a in starts and b in ends and starts[a] > at and ends[b] - starts[a] <= MAX_TOKENS:
                gold.append((starts[a], ends[b], kind))
                at = ends[b] - 1
        if len(tokens) <= 40:
            out.append((SemiMarkov.candidates(tokens, lambda a, b: text[a:b], left, right), len(tokens), gold))
    return out


def learn(docs: DataFrame) -> SemiMarkov:
    """The model from about SAMPLE texts with a digit or sign, drawn by a hash of doc_id; REGIONS examples at most."""
    rows = columns_of(docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    total = rows.count()
    model = SemiMarkov()
    if not total:
        return model
    share = int(min(1.0, SAMPLE / total) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands around the triggers of each text, not the whole of it; the fitted sample needs no more."""
        for batch in batches:
            found = []
            for doc_id, text in text_rows([batch], "doc_id", "text"):
                for tokens, _, _ in regions(text, [])[:4]:
                    found.append((doc_id, text[max(0, tokens[0][1] - 40) : tokens[-1][2] + 40]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.int64()), pa.array([c for _, c in found], pa.string())], names=["doc_id", "c"]
            )

    held = drawn.mapInArrow(contexts, "doc_id long, c string").where(F.length("c") <= 2000).orderBy("doc_id", "c").limit(4 * REGIONS).collect()
    pick, examples = random.Random(11), []
    for row in pick.sample(held, min(REGIONS, len(held))):
        text = row["c"]
        spans = base_spans(text)
        examples += example(text, spans)
        for kind, a, b in spans:
            cue = pick.choice(["", "", pick.choice(sorted(CUES[kind])) + " "])
            other, personal = rewritten(kind, text[a:b], pick)
            changed = text[:a] + cue + other + text[b:]
            start = a + len(cue)
            # Other spans are left out: only the rewritten one is labelled in its neighbourhood.
            near = changed[max(0, start - 30) : start + len(other) + 30]
            place = start - max(0, start - 30)
            if not base_spans(near) or personal:
                examples += example(near, [(kind, place, place + len(other))] if personal else [])
    model.fit(examples)
    return model


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, base and added, arrays of (kind, start, stop).

    Places are code points, stop exclusive. A null text is an empty one and has no spans.
    `base` holds the plain forms, which may overlap across kinds; `added` holds the
    model's, which overlap nothing. Repeated rows are repeated; an empty table gives no
    rows; other columns are ignored.
    """
    weights = dict(model.weights)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkov(weights)
        for batch in batches:
            base, added = [], []
            for (text,) in text_rows([batch], "text"):
                rules = base_spans(text or "")
                more = own.added(text or "", rules)
                for out, spans in ((base, rules), (added, more)):
                    out.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"]
            )

    kind = "array<struct<kind:string,start:bigint,stop:bigint>>"
    rows = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """The rows of `docs`, all columns, with spans in text masked; n_chars, where there is one, counts the new text."""
    weights = dict(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkov(weights)
        for batch in batches:
            texts = []
            for (text,) in text_rows([batch], "text"):
                rules = base_spans(text or "")
                texts.append(masked(text, rules + own.added(text or "", rules)))
            names = batch.schema.names
            columns = [pa.array(texts, batch.schema.field(n).type) if n == "text" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    changed = docs.mapInArrow(run, docs.schema)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed
