"""Secret scans: broad candidates, and a random forest that removes the false ones.

Candidates are long runs of characters with digits or mixed case, values of
assignments (anywhere in a text, with quotes and blanks or without) and blocks of private
keys. The forest looks at a candidate's length, character transitions (within the value, and
as likely as they are in the corpus), dictionary coverage (letter triples that are frequent in the
words of the corpus), path (source) and neighbouring words: three words before and one behind it and the
last two parts of the path, each as the share of secrets among the labelled findings with that word. While the forest is fitted,
a finding's shares come from other folds of values. Every tree leaves a third of the values out (where there are LEAST_VALUES of each label), and of values that the forest
was fitted on, only trees judge that did not know them. The name that a value is assigned to is no neighbouring word, as it may make the label.

It learns from labelled findings. Where none are given, the labels are what evidence outside
these features proves of some findings: the name that a value is assigned to or the format of
an issuer for a secret; a check digit, the syntax of an address or date, or a mark of a stand-in
against one. Most findings may have no such evidence: the forest judges them from those that
have, and the labelled ones too. It is fitted on a bounded sample: about MOST findings of each
label, drawn by the value's hash, a value in COPIES places at most. The dictionary counts all texts.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.common import claim, col, drop, small_batches, stored, text_steps
from tallyward.llm.forest import Forest, fit_forest

#: UNDECIDED is the probability, where there is no forest, of findings without a label: nothing speaks for a secret.
MOST, COPIES, LEAST_LENGTH, LEAST_ASSIGNED, SURE, UNDECIDED = 3_000, 3, 16, 8, 0.5, 0.25
MASK = "<SECRET>"
#: Names that announce a secret; formats that issuers fixed; marks of values that stand for a secret; marks of paths that hold examples.
NAMES = "password passwd pwd secret token apikey api_key api-key access_key secret_key private_key auth bearer credential key"
FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*"
STANDINS = "example changeme placeholder xxxx your_ dummy 123456789"
EXAMPLES = "test example sample demo doc fixture"

_NAMES = frozenset(NAMES.split())
#: Names that announce a secret as the last part of a longer one too (db_password; not primary_key).
_LAST_PARTS = frozenset("password passwd pwd secret token apikey".split())
_FORMATS = re.compile(FORMATS)
_STANDIN = re.compile("|".join(map(re.escape, STANDINS.split())), re.I)
_EXAMPLE = re.compile("|".join(EXAMPLES.split()), re.I)
_RUN = re.compile(r"(?<!\S)\S{%d,}" % LEAST_LENGTH)
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.DOTALL)
_QUOTES = ('"', "'", "`")
#: A name, perhaps quoted, and a sign of assignment, blanks round it. Nothing is tried twice, so long runs take linear time.
_ASSIGNED = re.compile(r"(?<![\w.\-])([\w.\-]++)[\"'`]?[^\S\r\n]*+(?::=|=>|==?|:)[^\S\r\n]*+")
_QUOTED = re.compile(r"""\"(?:\\.|[^\"\\\r\n])*+\"|'(?:\\.|[^'\\\r\n])*+'|`[^`\r\n]*+`""")
#: A value without quotes: up to a blank, a closing quote or the next name that is assigned.
_BARE = re.compile(r"""(?:[^\s,;&"'`]|[,;&](?!["'{\[]*[\w.\-]++["']?[=:])|["'`](?=\w))++""")
#: The password of a URL's user information. Passwords may hold @; the last one of the authority ends them.
_USERINFO = re.compile(r"(?<=://)[^\s/?#:@\"'<>]*+:([^\s/?#\"'<>]+)@")
_USERINFO_NAME = "userinfo:password"
_CREDENTIALS = re.compile(r"://[^\s/?#]*@")
_PARAMETER = re.compile(r"[?&;#]([\w.\-]++)=(?=[^&;#])")
_EMAIL = re.compile(r"(?:mailto:)?[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
_URL_MARKS = re.compile(r"\s|://")
_BEFORE, _AFTER = "([{<", "\"'`)]}>,;:."
_PART = re.compile(r"[_\-]")
_OUTER = "\"'`()[]{}<>,;.!?:"
#: A run without the punctuation around it.
_CORE = re.compile(r"[^\W_](?:.*[\w=/+])?|[-_+/].*[\w=/+]")
_PATH_PART = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_NUMBER = re.compile(r"\d(?:[ .\-]?\d){12,18}")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[T_]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+\-]\d\d:?\d\d)?)?")

#: None of these is what a label is made of (names, formats, check digits, syntax of addresses).
FEATURES = ("length", "transitions", "upper", "symbols", "distinct", "coverage", "likelihood", "longest_letters", "quoted", "example_path", "word_before", "word_after", "before_1", "before_2", "before_3", "after_1", "path_1", "path_2")
#: The features that are hashed words (0: none), by the table of shares they are looked up in; hashes, rows of the prior, folds.
CONTEXT = {"before": (12, 13, 14), "after": (15,), "path": (16, 17)}
CODES, PRIOR_ROWS, FOLDS, TREES = 1 << 14, 4.0, 5, 40
#: Values of each label from which on trees leave some out: with few, a tree without one might know nothing of its kind.
LEAST_VALUES = 50
#: Letters are told apart as a to z without accents; all else is one more sign.
SIGNS = 27


@cache
def _signs() -> np.ndarray:
    """The sign of each code point up to the end of Latin's extensions; the last entry stands for all others."""
    out = np.full(0x251, SIGNS - 1, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - ord("a")
    return out


def triples(text: str) -> np.ndarray:
    """Numbers of the text's runs of three signs."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x250)
    s = _signs()[points].astype(np.int64)
    return (s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:]


@dataclass
class Dictionary:
    """From counts of all triples of signs: frequent ones of letters, and how likely the third sign is behind the two before."""

    frequent: np.ndarray
    likelihood: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Dictionary:
        cube = counts.reshape(SIGNS, SIGNS, SIGNS).astype(float)
        letters = np.zeros_like(cube, bool)
        letters[:-1, :-1, :-1] = True
        frequent = letters & (cube > 0) & (cube * letters.sum() >= cube[letters].sum())
        return cls(frequent.ravel(), np.log((cube + 1) / (cube.sum(2, keepdims=True) + SIGNS)).ravel())


def dictionary(docs: DataFrame, *, text_col: str = "text") -> Dictionary:
    """Of all texts. The driver gets a count for each triple of signs, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIGNS**3, np.int64)
        for _, texts in text_steps(batches, text_col):
            counts += np.bincount(triples("\n".join(texts)), minlength=SIGNS**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["triple", "n"])

    counts = np.zeros(SIGNS**3, np.int64)
    for r in small_batches(docs.select(text_col)).mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect():
        counts[r.triple] = r.n
    return Dictionary.of(counts)


def announces(name: str) -> bool:
    """Whether a name in lower case, or the last part of it, announces a secret."""
    if name == _USERINFO_NAME:
        return True
    last = name.split(".")[-1]
    return last in _NAMES or _PART.split(last)[-1] in _LAST_PARTS


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) or (value != value.lower() and value[1:] != value[1:].lower() and value != value.upper())


def assignments(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, name in lower case, quoted) of the values of LEAST_ASSIGNED characters or more that are assigned to a name anywhere in a text; they can overlap.

    Names that announce no secret count where the value has digits or mixed case, or where name and value are one long run, and not as parameters of a URL.
    """
    reach = secret_reach = 0  # a value in one that counts as much is none of its own, so long chains of names take linear time
    urls = _Urls(text)
    for m in _ASSIGNED.finditer(text):
        name, at = m[1].lstrip("-.").lower(), m.end()
        secret = announces(name)
        if not name or m.start() < (secret_reach if secret else max(reach, secret_reach)) or text.startswith("//" if secret else ("/", "="), at):
            continue
        if not secret and (name[0].isdigit() or urls.hold(m.start())):
            continue
        quoted = text.startswith(_QUOTES, at)
        if quoted and (q := _QUOTED.match(text, at)):
            a, b = q.start() + 1, q.end() - 1
            if not secret and any(c.isspace() for c in text[a:b]):
                continue
        elif v := _BARE.match(text, at + quoted):
            a, b = v.end() - len(v[0].lstrip(_BEFORE)), v.start() + len(v[0].rstrip(_AFTER))
        else:
            continue
        if b - a < LEAST_ASSIGNED:
            continue
        if secret or _mixed(text[a:b]) or (b - m.start(1) >= LEAST_LENGTH and not any(c.isspace() for c in m[0])):
            reach, secret_reach = (reach, b) if secret else (b, secret_reach)
            yield a, b, name, quoted


class _Urls:
    """Whether a place of a text lies in a run with `://` before it. Asked for places in order, it reads the text once."""

    def __init__(self, text: str) -> None:
        self.marks, self.next, self.inside = _URL_MARKS.finditer(text), None, False

    def hold(self, at: int) -> bool:
        while (m := self.next or next(self.marks, None)) is not None and m.start() < at:
            self.inside, self.next = not m[0].isspace(), None
        self.next = m
        return self.inside


def candidates(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, assigned name in lower case or '', quoted) of the candidates of a text, in order, without overlap."""
    blocks = [m.span() for m in _BLOCK.finditer(text)] if "-----BEGIN" in text else []
    taken = [(a, b, "private_key", False) for a, b in blocks]
    # of values that overlap (user:password=...) those whose name announces a secret count, then the first
    ends, starts = [b for _, b in blocks], [a for a, _ in blocks]
    urls = ((*m.span(1), _USERINFO_NAME, False) for m in _USERINFO.finditer(text)) if "://" in text else ()
    for found in sorted([*urls, *assignments(text)], key=lambda f: (f[2] != _USERINFO_NAME, not announces(f[2]), f[0])):
        i = bisect.bisect_right(starts, found[0])
        if (i == 0 or ends[i - 1] <= found[0]) and (i == len(starts) or found[1] <= starts[i]):
            starts.insert(i, found[0])
            ends.insert(i, found[1])
            taken.append(found)
    taken.sort()
    out, k = list(taken), 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        while at < end:
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            stop = min(end, taken[k][0]) if k < len(taken) else end
            if stop - at >= LEAST_LENGTH and (core := _CORE.search(text[at:stop])):
                a, inner = at + core.start(), core[0]
                if len(inner) >= LEAST_LENGTH and _mixed(inner):
                    out.append((a, a + len(inner), "", text[a - 1 : a] in ("'", '"')))
            at = max(stop, taken[k][1]) if k < len(taken) else end
    yield from sorted(out)


def _plain_url(value: str) -> bool:
    """A URL without user information and secret-named parameters."""
    return "://" in value and not _CREDENTIALS.search(value) and not any(announces(m[1].lower()) for m in _PARAMETER.finditer(value))


def checked_number(value: str) -> bool:
    """A number of 13 to 19 digits whose last one is the check digit of the others, as cards and accounts have it."""
    if not _NUMBER.fullmatch(value):
        return False
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    return sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10


def evidence(value: str, name: str) -> int | None:
    """What is proven of a candidate: 1 a secret, 0 none, nothing in most cases.

    Of addresses, only plain e-mail addresses and URLs without user information are false; passwords in URLs and values of
    secret-named parameters are candidates of their own.
    """
    if value.startswith("-----BEGIN"):
        return 1
    if _STANDIN.search(value):
        return 0
    if name == _USERINFO_NAME or _FORMATS.fullmatch(value):
        return 1
    known = bool(_EMAIL.fullmatch(value) or _plain_url(value) or _DATE.fullmatch(value) or checked_number(value))
    if announces(name):
        return 1 if _mixed(value) and not known else None  # an assigned password may look like an address
    return 0 if known else None


def _code(kind: str, word: str) -> float:
    return float(zlib.crc32(f"{kind} {word.lower()}".encode("utf-8", "surrogatepass")) % CODES + 1)


def neighbours(text: str, path: str, a: int, b: int, name: str) -> list[float]:
    """The hashed words round a candidate and of its path, nearest first, 0 where there is none or no word. What stands before an assigned value counts from before its name on."""
    before = text[max(0, a - 120) : a]
    if name and (i := before.lower().rfind(name)) >= 0:
        before = before[:i]
    words = before.split()
    if a > 120 and not text[a - 121].isspace():
        words = words[1:]  # its start is cut off
    words = [w.strip(_OUTER) for w in words[:-4:-1]]
    after = [w for w in (x.strip(_OUTER) for x in text[b : b + 60].split()[:2]) if w][:1]
    parts = _PATH_PART.findall(path)[:-3:-1]
    out = []
    for kind, found, n in (("before", words, 3), ("after", after, 1), ("path", parts, 2)):
        out += [_code(kind, w) if kind == "path" or w.isalpha() else 0.0 for w in found] + [0.0] * (n - len(found))
    return out


def describe(text: str, path: str, a: int, b: int, name: str, quoted: bool, words: Dictionary) -> list[float]:
    """The features of a candidate."""
    value, n = text[a:b], b - a
    kinds = np.fromiter((0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in value), np.int8, n)
    own = triples(value)
    before, after = text[max(0, a - 60) : a].rstrip("\"'`").split(), text[b : b + 40].split()
    word = lambda ws, i: float(bool(ws) and ws[i].strip(_OUTER).isalpha())
    return [
        min(n, 200), float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, float((kinds == 1).mean()), float((kinds == 3).mean()), len(set(value)) / n,
        # of all the triples that a value of its length could have, those that words have
        float(words.frequent[own].sum()) / max(1, n - 2), float(words.likelihood[own].mean()) if len(own) else 0.0,
        max(map(len, _LETTERS.findall(value)), default=0) / n, float(quoted), float(bool(_EXAMPLE.search(path))), word(before, -1), word(after, 0),
        *neighbours(text, path, a, b, name),
    ]


def found_in(text: str, path: str, words: Dictionary) -> list[tuple[int, int, list[float], int | None]]:
    """(start, end, features, label) of the candidates of a text."""
    return [(a, b, describe(text, path, a, b, name, quoted, words), evidence(text[a:b], name)) for a, b, name, quoted in candidates(text)]


def digest_of(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def findings(docs: DataFrame, words: Dictionary, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, start, end (in characters), digest (of the value), features, label (see evidence, null for nothing), a row a candidate.

    Null texts have no candidate, a null or absent path counts as empty; repeated rows have their findings each; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, end long, digest string, features array<double>, label int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches, text_col):
            got, own = [], []
            for i, (text, path) in enumerate(zip(texts, col(part, "path").to_pylist(), strict=True)):
                for a, b, x, label in found_in(text, path or "", words):
                    got.append((a, b, digest_of(text[a:b]), x, label))
                    own.append(i)
            columns = list(zip(*got, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([col(part, id_col).take(pa.array(own, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "start", "end", "digest", "features", "label"])

    path = F.col(path_col) if path_col in docs.columns else F.lit("")
    return small_batches(docs.select(id_col, text_col, path.cast("string").alias("path"))).mapInArrow(run, schema)


def sampled(labelled: DataFrame, *, most: int = MOST) -> DataFrame:
    """(digest, features, label) of about `most` findings of each label, whole digests drawn by hash; null labels teach nothing.

    Equal values in many rows (copies) would fill the sample: a value and label counts in COPIES places with differing
    features at most, and the share to draw follows from what is left then.
    """
    w = Window.partitionBy("digest", "label").orderBy(F.xxhash64("features"), "features")
    known = labelled.filter(F.col("label").isNotNull()).select("digest", "features", "label").distinct()
    few = stored(known.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= COPIES).drop("nth"), "few-copies")
    n = {r[0]: r[1] for r in few.groupBy("label").count().collect()}
    draw = (F.xxhash64("digest", F.lit("secrets")) % (1 << 30) + (1 << 30)) / float(1 << 31)
    share = F.when(F.col("label") == 1, min(1.0, most / n.get(1, 1))).otherwise(min(1.0, most / n.get(0, 1)))
    return few.filter(draw <= share)


@dataclass
class Judge:
    """The forest, the shares of secrets by hashed word (a table for each kind of CONTEXT), and which trees could draw each value of the sample."""

    forest: Forest
    shares: dict[str, np.ndarray]
    drawn: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        """x with hashed words as shares."""
        return _encoded(x, self.shares)

    def predict(self, x: np.ndarray, digests: list[str]) -> np.ndarray:
        """The mean share of ones over the trees that a row's value was left out of (over all, if none)."""
        each = self.forest.each(self.encoded(x))
        free = np.ones(each.shape, bool)
        for i, d in enumerate(digests):
            if (seen := self.drawn.get(d)) is not None and not seen.all():
                free[:, i] = ~seen
        return (each * free).sum(0) / free.sum(0)


def _shares(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind of context, the share of ones by code, drawn towards the share of all; a finding counts once for a word."""
    base = float(y.mean()) if len(y) else 0.5
    out = {}
    for kind, columns in CONTEXT.items():
        n, ones = np.zeros(CODES + 1), np.zeros(CODES + 1)
        codes = np.sort(x[:, columns].astype(np.int64) % (CODES + 1), axis=1)
        once = np.ones(codes.shape, bool)
        once[:, 1:] = codes[:, 1:] != codes[:, :-1]
        np.add.at(n, codes[once], 1)
        np.add.at(ones, codes[once], np.broadcast_to(y[:, None], codes.shape)[once])
        out[kind] = (ones + PRIOR_ROWS * base) / (n + PRIOR_ROWS)
        out[kind][0] = base
    return out


def _encoded(x: np.ndarray, shares: dict[str, np.ndarray]) -> np.ndarray:
    out = x.astype(float).copy()
    for kind, columns in CONTEXT.items():
        for j in columns:
            out[:, j] = shares[kind][x[:, j].astype(np.int64) % (CODES + 1)]
    return out


def fit(labelled: DataFrame, *, most: int = MOST) -> Judge | None:
    """A forest from labelled findings (digest, features, label 1 or 0; null labels teach nothing); None without findings of both labels."""
    got = sorted((r.digest, r.label, list(r.features)) for r in sampled(labelled, most=most).collect())  # the order fixes the forest
    return judge_of([d for d, _, _ in got], np.array([f for _, _, f in got], float), np.array([k for _, k, _ in got], int))


def judge_of(digests: list[str], x: np.ndarray, y: np.ndarray) -> Judge | None:
    if not 0 < y.sum() < len(y):
        return None
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % FOLDS for d in digests])
    own = x.copy()
    for k in range(FOLDS):
        own[fold == k] = _encoded(x[fold == k], _shares(x[fold != k], y[fold != k]))
    # every tree leaves a third of the values out, if there are enough of either label
    values = min(len({d for d, k in zip(digests, y, strict=True) if k == label}) for label in (0, 1))
    allowed = np.array([[values < LEAST_VALUES or zlib.crc32(f"tree {t} {d}".encode()) % 3 > 0 for d in digests] for t in range(TREES)])
    forest = fit_forest(own, y, trees=TREES, allowed=allowed)
    drawn = {d: allowed[:, i] for i, d in enumerate(digests)}
    return Judge(forest, _shares(x, y), drawn)


def judged(found: DataFrame, forest: Judge | None, *, sure: float = SURE) -> DataFrame:
    """The findings with probability and secret (probability of `sure` or more). Without a forest the labels decide, findings without one are UNDECIDED and no secrets."""
    names = [c for c in found.columns if c != "features"]
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(forest, col(batch, "features").to_pylist(), col(batch, "label").to_pylist(), col(batch, "digest").to_pylist())
            yield pa.RecordBatch.from_arrays([*(col(batch, c) for c in names), pa.array(p), pa.array(p >= sure)], [*names, "probability", "secret"])

    return found.mapInArrow(run, f"{kinds}, probability double, secret boolean")


def probabilities(forest: Judge | None, features: list[list[float]], labels: list[int | None], digests: list[str]) -> np.ndarray:
    if forest is None:
        return np.array([UNDECIDED if x is None else x for x in labels], float)
    return forest.predict(np.array(features, float).reshape(len(features), len(FEATURES)), digests)


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, start, end, digest, label, probability, secret of all candidates; an empty table gives none. labelled: findings with labels from elsewhere."""
    found = stored(findings(docs, dictionary(docs, text_col=text_col), id_col=id_col, text_col=text_col, path_col=path_col), "findings")
    return judged(found, fit(found if labelled is None else labelled))


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", length_col: str = "n_chars", sure: float = SURE) -> DataFrame:
    """docs with every secret of its texts masked and length_col (if there) set to the new length; all else, and clean rows, as they were.

    The forest is fitted first; each row is then scanned and masked where it is, so nothing is shuffled. Null texts stay null, repeated rows are
    masked alike, an empty table gives none.
    """
    words = dictionary(docs, text_col=text_col)
    found = stored(findings(docs, words, id_col=id_col, text_col=text_col, path_col=path_col).filter("label IS NOT NULL"), "labelled")
    forest = fit(found)
    drop(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        for part, texts in text_steps(batches, text_col):
            new = [t.as_py() for t in col(part, text_col)]
            paths = col(part, path_col).to_pylist() if path_col in part.schema.names else [""] * len(texts)
            for i, (text, path) in enumerate(zip(texts, paths, strict=True)):
                if got := found_in(text, str(path or ""), words):
                    p = probabilities(forest, [x for _, _, x, _ in got], [r for *_, r in got], [digest_of(text[a:b]) for a, b, _, _ in got])
                    out, at = [], 0
                    for (a, b, _, _), q in sorted(zip(got, p, strict=True)):
                        if q >= sure and a >= at:
                            out += [text[at:a], MASK]
                            at = b
                    new[i] = "".join([*out, text[at:]])
            names = part.schema.names
            columns = [pa.array(new, part.schema.field(n).type) if n == text_col else col(part, n) for n in names]
            if length_col in names:
                old = col(part, length_col).to_pylist()
                k = [len(t) if t is not None and t != o else n for t, o, n in zip(new, col(part, text_col).to_pylist(), old, strict=True)]
                columns[names.index(length_col)] = pa.array(k, part.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).mapInArrow(run, docs.schema)
