"""Personal data: rules give base spans, a linear-chain conditional random field over word shapes adds to them.

Base spans are leftmost matches of each kind's pattern that pass its test.  The field labels the words of each line
that has a digit, `@` or `+` (lines without these hold no personal data of these kinds and aren't looked at); its parameters are fitted on the small table ``LABELLED`` below, by forward-backward in numpy on the
driver.  Viterbi decodes all such lines of a batch together.  A word is seen with marks of its neighbours, so the field adds what
the rules miss: card numbers that they lose to digits beside them, and phone numbers without a + after words such as
`call` or `tel`.  Its spans are added where no base span is.

Edge cases: null counts as empty text and has no spans.  Texts are searched whole, by themselves; long runs of
digits or letters are searched in linear time.  Repeated rows and ids, null ids and other columns change nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import text as tx
from sieveline.session import ship

#: Words whose scores a task remembers, and the longest of them.
KNOWN, LONG = 20_000, 64
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@+]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A small labelled table: lines in which spans stand as {kind:text}.
LABELLED = (
    "please write to {email:anna.berg@mail.example.com} before noon",
    "contact {email:the.42@mail3.example.com} or call {phone:+1 (212) 555-0147} today",
    "{email:info@shop.example.org}, {email:hr-team@corp.example.net}",
    "su correo es {email:juan_p@correo.example.es} gracias",
    "e-mail: {email:x.y+z@sub.domain.example.de}.",
    "the host {ip:192.168.10.254} answered",
    "login from {ip:10.0.0.7} failed and {ip:203.0.113.99} too",
    "adresse {ip:87.14.220.3}, port 8080",
    "version 1.2.3 of the tool, build 10.4",
    "section 3.1.4.1.5 and table 12.7",
    "from {ip:161.17.88.162} esta aqui {card:4556737586899855} y nada",
    "card {card:4556737586899855} was charged 25.00 euros",
    "paid with {card:4556 7375 8689 9855} on 12.05.2023",
    "number {card:5500-0055-5555-5559} ends in 59",
    "{card:6011000990139424}",
    "zahlung mit {card:378282246310005} am 3. Mai",
    "numeros {card:4556737586899855} {card:5500005555555559} fin",
    "order 4556737586899854 is not a card",
    "invoice 1234567890123456 and 9999888877776666 were sent",
    "serial 20230512001 reference 88213",
    "token 04dbebab91ab85687d33eeaaf9ac699e1188f962 stays",
    "isbn 978-3-16-148410-0 costs 12 euros",
    "call {phone:+1 (017) 555-7713} now",
    "phone {phone:+49 30 1234567} or {phone:+33 1 23 45 67 89}",
    "tel {phone:+1-800-555-0199}, fax {phone:+1.800.555.0198}",
    "{phone:+1 (974) 555-3436} that is it",
    "{phone:+1 (487) 555-7209} {ip:161.17.88.162} rest",
    "reach me at {phone:+442071838750} any day",
    "the sum is +5 and then +12 percent",
    "a + b = c and 2 + 2 = 4",
    "c++ and g++ at 100 percent",
    "in 2019 there were 1,234,567 people in 12 towns",
    "page 10 of 25 (see 3-4)",
    "meet @ noon or @home tonight",
    "prices rose 3.5 % since 1999-12-31 at 10:45",
    "nothing to see in this line of words",
    "call {phone:(212) 555-0147} today",
    "or call {phone:(646) 555-0192} before noon",
    "phone {phone:555-0147} for details",
    "phone: {phone:(415) 555-2671}",
    "tel {phone:030 1234567} oder schreiben sie",
    "tel: {phone:(030) 555-1234}, fax {phone:(030) 555-1235}",
    "mobile {phone:0171 5551234} or {phone:+49 171 5551234}",
    "bitte tel. {phone:0711 123456} anrufen",
    "llame al {phone:912 345 678} por favor",
    "telefono {phone:912 345 678} y fin",
    "fax {phone:555-0199} is off",
    "see (212) in the list of 555 items",
    "the room 030 holds 1234567 items",
    "score of 912 345 678 points",
    "order 555-0147 was sent to room (212)",
    "from 0711 to 123456 in steps",
    "parts 030 1234567 and 555-0147 are in stock",
    "he said call me in 2019 or at 10:45",
    "a phone costs 250 euros and a mobile 300",
    "another plain line that has no number at all",
    "un texto sencillo sin ningun dato personal",
    "ein ganz normaler satz ohne daten und zahlen",
)


def luhn(digits: str) -> bool:
    """Whether the check sum of the digits is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, each found from its @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        found = _LOCAL.match(text, start) if start < at else None
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def core(word: str) -> tuple[int, int]:
    """Start and end of a word without the punctuation around it."""
    a, b = 0, len(word)
    while a < b and word[a] in "\"'<[{|,;:=":
        a += 1
    while b > a and word[b - 1] in "\"'>]}|.,;:!?":
        b -= 1
    return a, b


def _features(word: str) -> tuple[str, ...]:
    """What the field sees of a word itself."""
    a, b = core(word)
    word = word[a:b]
    if not _MARK.search(word):
        return ("plain",)
    digits = "".join(c for c in word if "0" <= c <= "9")
    shape = re.sub(r"[^\W\d_]+", "x", re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}", word))[:24]
    out = ["marked", f"shape={shape}", f"digits={min(len(digits), 20)}", f"letters={any(c.isalpha() for c in word)}"]
    if _LOCAL.fullmatch(word):
        out.append("email")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", word):
        out.append("quad" if all(int(p) <= 255 for p in word.split(".")) else "wide quad")
    if 14 <= len(digits) <= 19 and re.fullmatch(r"[0-9-]+", word):
        out.append("luhn" if luhn(digits) else "no luhn")
    if re.fullmatch(r"\+[0-9][0-9().-]*", word):
        out.append("plus digits" if len(digits) < 10 else "plus number")
    if re.fullmatch(r"\([0-9]{2,4}\)", word):
        out.append("area")
    if re.fullmatch(r"[0-9]{4}", word):
        out.append("four")
    if re.fullmatch(r"[0-9]{2,4}-[0-9]{2,5}", word):
        out.append("number part")
    return tuple(out)


def _hint(word: str) -> str:
    """What the field sees of a neighbour: a plain word's letters, another's shape."""
    a, b = core(word)
    word = word[a:b].lower()
    return word[:12] if not _MARK.search(word) else re.sub(r"[^\W\d_]+", "x", re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}", word))[:12]


def _labelled(line: str) -> tuple[list[str], list[int]]:
    """Words and label numbers of a line of the table."""
    text, spans = "", []
    for part in re.split(r"(\{\w+:[^}]*\})", line):
        found = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
        if found:
            spans.append((found[1], len(text), len(text) + len(found[2])))
        text += found[2] if found else part
    words, labels = [], []
    for m in _WORD.finditer(text):
        inside = [(k, a) for k, a, b in spans if a < m.end() and m.start() < b]
        first = inside and inside[0][1] >= m.start()
        label = "O" if not inside else inside[0][0] if first or inside[0][0] in ("email", "ip") else inside[0][0] + "+"
        words.append(m[0])
        labels.append(LABELS.index(label))
    return words, labels


class Field:
    """Weights of features by label, and of steps between labels."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, n))
        self.change = np.zeros((n, n))
        self.start = np.zeros(n)
        self.known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _scores(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a word adds to its own labels, to the next word's, and to those of the one before it."""
        found = self.known.get(word)
        if found is None:
            hint = _hint(word)
            named = (_features(word), (f"after {hint}",), (f"before {hint}",))
            found = tuple(sum((self.weights[k] for f in fs if (k := self.index.get(f)) is not None), np.zeros(len(LABELS))) for fs in named)
            if len(word) <= LONG:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[word] = found
        return found

    def emission(self, words: list[str], at: np.ndarray | None = None) -> np.ndarray:
        """Scores of words x labels; the neighbours in the same line (at[i]:at[i+1]) count too."""
        if not words:
            return np.zeros((0, len(LABELS)))
        own, after, before = (np.stack(x) for x in zip(*map(self._scores, words), strict=True))
        first = np.zeros(len(words) + 1, bool)
        first[[0, len(words)] if at is None else at] = True
        out = own
        out[1:] += after[:-1] * ~first[1:-1, None]
        out[:-1] += before[1:] * ~first[1:-1, None]
        return out

    def fit(self, table: tuple[str, ...] = LABELLED, rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> Field:
        """Gradient ascent (Adam) on the likelihood of the table's labels."""
        lines = [_labelled(x) for x in table]

        def seen_at(words: list[str], i: int) -> list[str]:
            near = [f"after {_hint(words[i - 1])}"] if i else []
            return [*_features(words[i]), *near, *([f"before {_hint(words[i + 1])}"] if i + 1 < len(words) else [])]

        for words, _ in lines:
            for i in range(len(words)):
                for f in seen_at(words, i):
                    self.index.setdefault(f, len(self.index))
        n, m = len(LABELS), len(self.index)
        self.weights = np.zeros((m, n))
        seen = []
        for words, labels in lines:
            x = np.zeros((len(words), m))
            for i in range(len(words)):
                x[i, [self.index[f] for f in seen_at(words, i)]] = 1
            seen.append((x, np.array(labels)))
        params = [self.weights, self.change, self.start]
        slope, scale = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, rounds + 1):
            grads = [-decay * p for p in params]
            for x, y in seen:
                e = x @ self.weights
                k = len(y)
                ahead, behind = np.empty((k, n)), np.zeros((k, n))
                ahead[0] = e[0] + self.start
                for i in range(1, k):
                    ahead[i] = e[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + self.change, axis=0)
                for i in range(k - 2, -1, -1):
                    behind[i] = np.logaddexp.reduce(self.change + (e[i + 1] + behind[i + 1])[None, :], axis=1)
                whole = np.logaddexp.reduce(ahead[-1])
                share = np.exp(ahead + behind - whole)
                truth = np.eye(n)[y]
                grads[0] += x.T @ (truth - share)
                grads[2] += truth[0] - share[0]
                for i in range(1, k):
                    both = np.exp(ahead[i - 1][:, None] + self.change + (e[i] + behind[i])[None, :] - whole)
                    grads[1] -= both
                    grads[1][y[i - 1], y[i]] += 1
            for p, a, b, g in zip(params, slope, scale, grads, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
        self.known.clear()
        return self

    def spans(self, lines: list[list[tuple[int, int, str]]]) -> list[list[tuple[str, int, int]]]:
        """The field's spans of lines of (start, end, word); all lines are decoded together."""
        flat = [w for line in lines for w in line]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
        label = tx.viterbi(self.emission([w for _, _, w in flat], at), at, self.change, self.start)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            found: list[tuple[str, int, int]] = []
            open_ = False
            for i in range(a, b):
                name = LABELS[label[i]]
                if name == "O":
                    open_ = False
                    continue
                kind = name.rstrip("+")
                start, _, word = flat[i]
                lo, hi = core(word)
                if lo == hi:
                    continue
                if name.endswith("+") and open_ and found[-1][0] == kind:
                    found[-1] = (kind, found[-1][1], start + hi)
                elif not name.endswith("+"):
                    found.append((kind, start + lo, start + hi))
                    open_ = True
                else:
                    open_ = False
            out.append([s for s in found if s[2] > s[1]])
        return out


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
    lines, owner = [], []
    for i, t in enumerate(texts):
        done = 0
        for m in _MARK.finditer(t):
            if m.start() < done:
                continue
            a = t.rfind("\n", done, m.start()) + 1 or done
            b = t.find("\n", m.start())
            done = len(t) if b < 0 else b + 1
            lines.append([(a + w.start(), a + w.end(), w[0]) for w in _WORD.finditer(t[a:done])])
            owner.append(i)
    every = [list(b) for b in base]
    if lines:
        for i, found in zip(owner, field.spans(lines), strict=True):
            for kind, a, b in found:
                if all(b <= x or y <= a for _, x, y in base[i]):
                    every[i].append((kind, a, b))
    return [(b, sorted(e, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) for b, e in zip(base, every, strict=True)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by <KIND>; spans that overlap become one, of the first's kind."""
    out, done, joined = [], 0, []
    for kind, a, b in spans:
        if joined and a < joined[-1][2]:
            joined[-1] = (joined[-1][0], joined[-1][1], max(b, joined[-1][2]))
        else:
            joined.append((kind, a, b))
    for kind, a, b in joined:
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
#: Texts of a batch whose lines are decoded together.
_TOGETHER = 2000


def personal_data(docs: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, a hash of them, and all spans, of every row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Field().fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            hashes, spans = [], []
            for lo in range(0, batch.num_rows, _TOGETHER):
                texts = [x or "" for x in batch.column(1).slice(lo, _TOGETHER).to_pylist()]
                for base, every in find(texts, shared.value):
                    for k, kind in enumerate(KINDS):
                        counts[k].append(sum(s[0] == kind for s in base))
                    hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with <KIND> in the place of each span; n_chars follows the text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Field().fit())

    @F.pandas_udf("string")
    def mask(column):  # noqa: ANN001, ANN202
        texts = column.tolist()
        found = find([t or "" for t in texts], shared.value)
        return column.__class__([None if t is None else masked(t, every) for t, (_, every) in zip(texts, found, strict=True)], dtype=object)

    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
