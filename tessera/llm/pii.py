"""Personal data in texts: four base patterns, and a character-level bidirectional LSTM with a CRF that finds what they miss.

Base spans come from patterns over the UTF-8 bytes, each linear in the text. The tagger is trained in numpy on the
driver from windows of a bounded sample of documents, labelled with their base spans: a window as it stands, one
in which the span is rewritten in a form the patterns do not know (words or brackets for
signs, other separators, no plus), or one with a number that is no personal data. So it learns the
kinds by shape and surroundings, with the corpus' own text around them. It is broadcast (some 40 kB).

All documents are then tagged in one scan. Every span of the kinds holds a digit, an @ or a word for a sign; text
near one of these is cut into overlapping windows, which are decoded in batches. Windows are reconciled over the whole
document: spans cut by the inner edge of a window give way to the same span whole in the next one, or are joined
where no window holds it whole, and the set of spans without overlap that has the greatest total score stays.
A span that the tagger adds must pass the check of its kind (Luhn, parts of an address, number of
digits), end at the end of a word and overlap no base span.

Defined cases: null and empty texts have no spans; a corpus without base spans in its sample trains no tagger and only
base spans come out; rows that share a doc_id are judged each for itself, repeated rows are each returned;
rows without doc_id are left out; other columns are ignored, whatever their names; a long text is scanned whole, and only the
windows near a sign are decoded, a bounded number at a time.
"""

from __future__ import annotations

import bisect
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import char_tagger as T
from . import common as C

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3_000
WINDOWS_EACH = 6
WINDOW, STRIDE = 112, 56
TRAIN_WIDTH = 64
STEPS, BATCH = 400, 32
WIDTH, HIDDEN = 12, 16
SEED = 7
DECODE = 512

_TAIL = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = C.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[^0-9]+")
_SIGNS = re.compile(rb"[0-9@]|[\[({<] ?(?:at|dot) ?[\])}>]|(?<![A-Za-z])dot(?![A-Za-z])", re.IGNORECASE)

# Characters as the tagger sees them: letters without case, one digit, other ASCII as it is, all else one; the last pads.
_CHARS = 130
_PAD = 129
_CHAR = np.full(129, 128, np.int64)
_CHAR[:128] = np.arange(128)
_CHAR[65:91] += 32
_CHAR[48:58] = 48
LABELS = 1 + 2 * len(KINDS)  # none, then first and later characters of each kind
_BARRED = np.array([[b and b % 2 == 0 and a not in (b - 1, b) for b in range(LABELS)] for a in range(LABELS)])


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: bytes | str) -> bool:
    part = part.lstrip(b"0" if isinstance(part, bytes) else "0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order; a kind's candidates are met from the left and those that fail its check are dropped."""
    out, end = [], 0
    if b"@" in text:
        codes = np.frombuffer(text, np.uint8)
        for m in _TAIL.finditer(text):
            a, size = m.start(), 64
            while True:  # back over the local part, to the last match at most
                low = max(end, a - size)
                other = np.flatnonzero(~_LOCAL[codes[low:a]])
                if len(other) or low == end:
                    break
                size *= 4
            low = low + int(other[-1]) + 1 if len(other) else low
            if low < a:
                out.append((low, 0, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split(b"."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub(b"", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits.decode()):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub(b"", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_AT = re.compile(r" ?(?:@|[\[({<] ?(?:at|@) ?[\])}>]|(?<= )at(?= )|&#64;) ?", re.IGNORECASE)
_DOT = re.compile(r" ?(?:\.|[\[({<] ?(?:dot|\.) ?[\])}>]|(?<= )dot(?= )) ?", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9_%+-]+")
_CARD_FORM = re.compile(r"[0-9]+(?:[ ./_ -]{1,2}[0-9]+)*")
_PHONE_FORM = re.compile(r"[+(0-9][0-9 ()./ -]*[0-9]")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d)(?!\d)")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"[1-9][0-9]*(?:\.[0-9]+)?")


def passes(kind: int, found: str) -> bool:
    """Whether a span that the tagger found can be of its kind at all."""
    if kind == 0:
        at = _AT.split(found)
        host = _DOT.split(at[-1])
        return len(at) == 2 and len(host) > 1 and all(_LABEL.fullmatch(x) for x in [*_DOT.split(at[0]), *host]) and len(host[-1]) > 1 and host[-1].isalpha()
    if kind == 1:
        if ":" in found:
            try:
                return ipaddress.ip_address(found).version == 6 and found.count(":") > 2 and len(_DIGIT.findall(found)) > 1
            except ValueError:
                return False
        parts = _DOT.split(found)
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and _small(x) for x in parts)
    digits = "".join(_DIGIT.findall(found))
    if kind == 2:
        return 14 <= len(digits) <= 19 and _CARD_FORM.fullmatch(found) is not None and luhn(digits)
    book = len(digits) == 13 and digits.startswith(("978", "979"))
    number = _NUMBER.fullmatch(found) is not None
    return 10 <= len(digits) <= 15 and not book and not number and _PHONE_FORM.fullmatch(found) is not None and found.count("(") == found.count(")") and not _DATE.match(found)


def _ids(chars: np.ndarray) -> np.ndarray:
    return _CHAR[np.minimum(chars, 128)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _code_points(text: bytes, at: list[int]) -> list[int]:
    """Code point offsets of sorted byte offsets."""
    if text.isascii():
        return list(at)
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    out, done, n = [], 0, 0
    for a in at:
        n += int(np.count_nonzero(begins[done:a]))
        done = a
        out.append(n)
    return out


def _segments(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges near a sign, on whole characters."""
    out, reach = [], WINDOW // 2
    for m in _SIGNS.finditer(text):
        a, z = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    for s in out:
        while s[0] and text[s[0]] & 0xC0 == 0x80:
            s[0] -= 1
        while s[1] < len(text) and text[s[1]] & 0xC0 == 0x80:
            s[1] += 1
    return [(a, z) for a, z in out]


def _label(n: int, spans) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, kind, z in spans:
        y[a:z] = 2 * kind + 2
        y[a] = 2 * kind + 1
    return y


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of a row of labels."""
    out = []
    edges = np.flatnonzero(np.r_[labels != 0, False])
    for t in edges:
        lab = int(labels[t])
        if lab % 2:
            out.append([int(t), (lab - 1) // 2, int(t) + 1])
        else:
            out[-1][2] = int(t) + 1
    return [tuple(s) for s in out]


def reconcile(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """The spans of a document from those of its windows (start, kind, end, score, cut by an inner edge)."""
    whole = {}
    for a, kind, z, score, cut in found:
        if not cut:
            whole[a, kind, z] = max(score, whole.get((a, kind, z), score))
    held = sorted(whole)
    parts = sorted((a, kind, z, score) for a, kind, z, score, cut in found if cut)
    joined: dict[int, list] = {}
    for a, kind, z, score in parts:
        if any(b < z and a < y and k == kind for b, k, y in held):
            continue
        open_ = joined.get(kind)
        if open_ is not None and a <= open_[2]:
            open_[2], open_[3] = max(open_[2], z), open_[3] + score
            continue
        if open_ is not None:
            whole[open_[0], kind, open_[2]] = open_[3]
        joined[kind] = [a, kind, z, score]
    for kind, open_ in joined.items():
        whole[open_[0], kind, open_[2]] = open_[3]
    order = sorted((z, a, kind, score) for (a, kind, z), score in whole.items() if score > 0)
    ends, best = [x[0] for x in order], [(0.0, None)]
    for n, (z, a, kind, score) in enumerate(order):
        before = bisect.bisect_right(ends, a, 0, n)
        take = best[before][0] + score
        best.append((take, (before, (a, kind, z))) if take > best[n][0] else (best[n][0], None))
    out, n = [], len(order)
    while n:
        if best[n][1] is None:
            n -= 1
        else:
            n, span = best[n][1]
            out.append(span)
    return out[::-1]


def decode(model: dict, segments: list[np.ndarray]) -> list[list[tuple[int, int, int, float, bool]]]:
    """For each segment (code points) the spans of its overlapping windows."""
    out = [[] for _ in segments]
    places = [(k, a) for k, s in enumerate(segments) for a in range(0, max(1, len(s) - (WINDOW - STRIDE)), STRIDE)]
    for p in range(0, len(places), DECODE):
        part = places[p : p + DECODE]
        ids = np.full((len(part), WINDOW), _PAD)
        for row, (k, a) in enumerate(part):
            x = segments[k][a : a + WINDOW]
            ids[row, : len(x)] = _ids(x)
        e = T.emissions(model, ids)
        labels = T.viterbi(model, e, _BARRED)
        for row in np.flatnonzero(labels.any(1)):
            k, a = part[row]
            size = min(WINDOW, len(segments[k]) - a)
            for s, kind, z in spans_of(labels[row, :size]):
                own = e[np.arange(s, z), row, labels[row, s:z]] - e[s:z, row, 0]
                cut = (s == 0 and a > 0) or (z == size and a + size < len(segments[k]))
                out[k].append((a + s, kind, a + z, float(own.sum()), cut))
    return out


def added_spans(model: dict, texts: list[bytes], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in bytes of what the tagger finds beside the base spans of each text."""
    segments, owner = [], []
    for n, text in enumerate(texts):
        for a, z in _segments(text):
            segments.append((n, a, text[a:z].decode("utf-8", "replace")))
            owner.append(n)
    found = [[] for _ in texts]
    for p in range(0, len(segments), DECODE):
        part = segments[p : p + DECODE]
        for (n, a, s), spans in zip(part, decode(model, [_points(s) for _, _, s in part]), strict=True):
            for x, kind, y in reconcile(spans):
                while x < y and s[x].isspace():
                    x += 1
                while x < y and (s[y - 1].isspace() or s[y - 1] in ".,;"):
                    y -= 1
                joined = (x and s[x - 1].isalnum() and s[x].isalnum()) or (y < len(s) and s[y].isalnum())
                if x == y or joined or not passes(kind, s[x:y]):
                    continue
                b = a + len(s[:x].encode())
                z = b + len(s[x:y].encode())
                if not any(u < z and b < v for u, _, v in base[n]):
                    found[n].append((b, kind, z))
    return found


def _named(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    at = sorted({x for a, _, z in spans for x in (a, z)})
    to = dict(zip(at, _code_points(text, at), strict=True))
    return [{"kind": KINDS[kind], "start": to[a], "end": to[z]} for a, kind, z in sorted(spans)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"


def _find(shared):
    def run(batches):
        model = shared.value
        for ids, texts in C.slices(batches):
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base) if model else [[] for _ in texts]
            own = [_named(t, b) for t, b in zip(texts, base, strict=True)]
            both = [_named(t, b + m) if m else o for t, b, m, o in zip(texts, base, more, own, strict=True)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(own, _SPANS), pa.array(both, _SPANS)], ["doc_id", "base", "spans"])

    return run


def _windows(batches):
    """Windows of a sampled document, with the labels of its base spans: near spans and near other signs, some of each."""
    reach = 2 * TRAIN_WIDTH
    for ids, texts in C.slices(batches):
        for d, text in zip(ids, texts, strict=True):
            base = base_spans(text)
            covered = lambda p: any(a <= p < z for a, _, z in base)  # noqa: B023, E731
            others = []
            for m in _SIGNS.finditer(text):
                if len(others) == WINDOWS_EACH:
                    break
                if not covered(m.start()) and (not others or m.start() > others[-1] + TRAIN_WIDTH):
                    others.append(m.start())
            for p in [a for a, _, _ in base[:WINDOWS_EACH]] + others:
                low, high = max(0, p - reach), min(len(text), p + reach)
                piece = text[low:high].decode("utf-8", "ignore")
                yield C.rows(C.arrow("doc_id long, start long, text string"), [int(d)], [int(p)], [piece])


# Last labels of host names that rewritten addresses end in.
_TOPS = "com org net de fr es it info io edu".split()
_WORD = re.compile(r"[a-z]{2,12}")


class Rewriter:
    """Forms of each kind that the base patterns do not know, and numbers that are no personal data; all by one generator."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(str(x) for x in self.r.integers(0, 10, n))

    def email(self, words: list[str]) -> str:
        name = self.pick(words) + self.pick(["", f".{self.pick(words)}", f"_{self.pick(words)}", self.digits(2), f".{self.digits(2)}"])
        host = [self.pick(words) + self.pick(["", self.digits(1)]), *([self.pick(words)] if self.r.random() < 0.4 else [])]
        at, dot = self.pick([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" at ", " dot "), (" AT ", " DOT "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), ("@", "[.]"), ("@", " dot "), ("{at}", "{dot}"), ("<at>", "."), ("&#64;", ".")])
        return name + at + dot.join([*host, self.pick(_TOPS)])

    def ip(self, words: list[str]) -> str:
        if self.r.random() < 0.3:
            groups = [f"{int(x):x}" for x in self.r.integers(0, 65536, 8)]
            return self.pick([":".join(groups), ":".join(groups[: (n := int(self.r.integers(2, 5)))]) + "::" + ":".join(groups[-2:][: 6 - n])])
        return self.pick(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"]).join(str(x) for x in self.r.integers(0, 256, 4))

    def card(self, words: list[str]) -> str:
        n = int(self.pick([16, 16, 16, 15, 14, 19]))
        d = self.digits(n - 1)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        sep = self.pick([".", "  ", "/", "_", " ", " - "[:2]])
        return sep.join(d[i : i + 4] for i in range(0, n, 4))

    def phone(self, words: list[str]) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"0{self.digits(3)} {self.digits(7)}", f"0{self.digits(3)}/{self.digits(7)}", f"00{self.digits(2)} {self.digits(2)} {self.digits(7)}", f"+{self.digits(2)} (0){self.digits(2)}/{self.digits(6)}", f"+1/{a}/{b}/{c}", f"({a}) {b} {c}", f"0{self.digits(1)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}"])

    def other(self, words: list[str]) -> str:
        y, m, d = int(self.r.integers(1900, 2100)), int(self.r.integers(1, 13)), int(self.r.integers(1, 29))
        n = lambda k: int(self.r.integers(1, 10**k))
        return self.pick([
            f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}-{m:02}-{d:02} {d:02}:{m:02}:{n(2):02}", f"{d:02}:{n(2):02}", f"${n(3)},{self.digits(3)}.{self.digits(2)}", f"{n(2)}.{n(1)}.{n(2)}", f"v{n(1)}.{n(2)}", f"{n(1)}.{n(1)}", f"{y}-{y + 10}",
            f"ISBN 978-{n(1)}-{self.digits(2)}-{self.digits(6)}-{n(1)}", f"3.{self.digits(12)}", f"pp. {n(3)}-{n(3)}", f"{n(3)} at {self.pick(words)}", f"{self.digits(8)}-{self.digits(4)}-4{self.digits(3)}-{self.digits(4)}-{self.digits(12)}", f"no. {n(9)}", f"{n(3)} {self.digits(3)} {self.digits(3)}",
            "".join(self.pick("0123456789abcdef") for _ in range(int(self.pick([18, 32, 40])))), "".join(self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), f"dot {self.pick(words)}", f"{self.pick(words)} at {self.pick(words)}", f"@{self.pick(words)}", f"{self.digits(16)}", f"{n(2)} % {self.pick(words)}", f"{n(2)}x{n(2)}", f"§ {n(2)}.{n(1)}", self.digits(int(self.r.integers(5, 13))), f"{self.digits(24)}",
        ])


def example(text: str, way: float, rewriter: Rewriter) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) of a training window from a sampled one: as it stands, with a span in another form, or with another number in."""
    raw = text.encode()
    byte_spans = base_spans(raw)
    at = sorted({x for a, _, z in byte_spans for x in (a, z)})
    to = dict(zip(at, _code_points(raw, at), strict=True))
    spans = [(to[a], kind, to[z]) for a, kind, z in byte_spans]
    # a number with the form of a card is one to the tagger; the check of its digits follows
    for m in _CARD.finditer(raw):
        if 14 <= len(_DIGITS.sub(b"", m.group())) <= 19:
            a = len(raw[: m.start()].decode())
            z = a + len(m.group())
            if not any(u < z and a < v for u, _, v in spans):
                spans.append((a, 2, z))
    words = _WORD.findall(text) or ["name"]
    if way < 0.35 or not spans:
        if way >= 0.35:  # no span here: put one, or a number, at a word's end
            gaps = [m.end() for m in re.finditer(r"\s", text)] or [0]
            p = rewriter.pick(gaps)
            kind = None if way < 0.6 else int(rewriter.r.integers(len(KINDS)))
            new = (rewriter.other(words) if kind is None else getattr(rewriter, KINDS[kind])(words))
            text, spans = text[:p] + new + " " + text[p:], [] if kind is None else [(p, kind, p + len(new))]
            centre = p
        else:
            centre = spans[0][0] if spans else len(text) // 2
    else:
        a, _, z = spans[int(rewriter.r.integers(len(spans)))]
        kind = None if way < 0.55 else int(rewriter.r.integers(len(KINDS)))
        new = (rewriter.other(words) if kind is None else getattr(rewriter, KINDS[kind])(words))
        grown = len(new) - (z - a)
        moved = [(x + grown * (x >= z), k, y + grown * (x >= z)) for x, k, y in spans if y <= a or x >= z]
        text = text[:a] + new + text[z:]
        spans = moved + ([] if kind is None else [(a, kind, a + len(new))])
        if kind is None and re.fullmatch("[0-9]{14,19}", new):
            spans.append((a, 2, a + len(new)))
        centre = a
    y = _label(len(text), sorted(spans))
    low = max(0, min(centre - int(rewriter.r.integers(4, TRAIN_WIDTH - 24)), max(0, len(text) - TRAIN_WIDTH)))
    chars, y = _ids(_points(text))[low : low + TRAIN_WIDTH], y[low : low + TRAIN_WIDTH].copy()
    if y[0] and y[0] % 2 == 0:  # a span that begins before the window
        y[0] -= 1
    ids, labels = np.full(TRAIN_WIDTH, _PAD), np.zeros(TRAIN_WIDTH, np.int64)
    ids[: len(chars)], labels[: len(chars)] = chars, y
    return ids, labels


def fit(texts: list[str], steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> dict[str, np.ndarray] | None:
    """A tagger from sampled windows; none without a base span in any."""
    if not any(base_spans(t.encode()) for t in texts):
        return None
    rewriter = Rewriter(seed)
    batches = []
    for _ in range(steps):
        rows = [example(texts[int(rewriter.r.integers(len(texts)))], float(rewriter.r.random()), rewriter) for _ in range(batch)]
        batches.append((np.stack([x for x, _ in rows]), np.stack([y for _, y in rows])))
    model = T.init(_CHARS, LABELS, WIDTH, HIDDEN, seed)
    model["first"][2::2] = T.BARRED  # no window begins inside a span
    return T.train(model, batches, _BARRED)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Fit on windows of about `sample` of the documents that hold a digit or an @, drawn by a hash of doc_id."""
    texts = C.texts_of(docs)
    signs = texts.where(F.col("text").rlike("[0-9@]"))
    n = signs.select("doc_id").count()
    share = 1 << 20
    drawn = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < -(-sample * share // max(1, n))).where(F.col("text").rlike("[0-9@]"))
    got = drawn.mapInArrow(_windows, "doc_id long, start long, text string").orderBy("doc_id", "start", "text").toArrow()  # 2 WINDOWS_EACH short texts a document
    return fit(got["text"].to_pylist())


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and spans (base and added): arrays of kind, start and end in code points, by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    return C.texts_of(docs).mapInArrow(_find(shared), f"doc_id long, base {_SPAN_TYPE}, spans {_SPAN_TYPE}")
