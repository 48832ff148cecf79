"""Abusive, hateful or sexual content: noisy-channel restoration of disguised words, then a fitted score.

A disguised word (leetspeak, spaced or dotted letters, repeated letters, masks, look-alike letters,
broken charsets) becomes a lattice: each observed sign has the letters it may stand for. Viterbi
search finds the most probable word in the lattice under a character language model, which is
counted over the words of all documents. The restored text is scored clause by clause with weights
fitted to reviewed documents (see llm.clause_model); no word is listed here. Words that the fit found
telling decide where a sign can be read either way.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelight.llm.clause_model import ClauseModel, Scorer, fit

A = 27  # word border and 26 letters
ORDER = 4
CONTEXTS = A ** (ORDER - 1)
TABLE = A**ORDER  # proven size of the model: 531,441 counts

# ---- fixed values: the channel. What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i"}
LOOKALIKE = str.maketrans("аеорсухіјѕкмтнвԁɡαοερνιτκ", "aeopcyxijskmthbdgaoepvitk")
WILD = "*#�"
ANY = "abcdefghijklmnopqrstuvwxyz"
HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
PLAIN = str.maketrans({"ß": "ss", "ł": "l", "œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ı": "i", "’": "'", "´": "'"})

#: A token that is not plain: hidden or look-alike letters, signs or digits amid letters, masks, long repeats, single letters set apart.
SUSPECT = re.compile(
    r"[\u00ad\u200b-\u200d\u2060\ufeff\ufffd\u0370-\u04ff]|[^\W\d_][0-9@$!|+€£*#?]+[^\W\d_]|^[@$0-9*]+[^\W\d_]+|[^\W\d_]\*|([^\W\d_])\1\1|(?:^|\W)[^\W\d_](?:[.\-_*'|][^\W\d_](?![^\W_])){2}|[ÃÂÄÅĹĂ][^\x00-\x7f]"
)
#: Plain but for signs at its end or beginning, or with doubled letters: looked at if a telling word can be meant.
END = re.compile(r"[^\W\d_][0-9@$|+€£!]+$")
START = re.compile(r"^\d+[a-z]{1,3}$")
TWICE = re.compile(r"([a-z])\1")
JOINT = re.compile(r"([\-/'_.,]+)")
SPACED = re.compile(r"(?<![\w@])[\w@$](?:[ .\-_*'|]+[\w@$](?![\w@])){2,}")
TOKEN = re.compile(r"\S+")
MIXED = re.compile(r"[a-z][\u0370-\u04ff]|[\u0370-\u04ff][a-z]")
SIGNS = "0123456789@$|+€£!"
APART = re.compile(r"(?<!\S)[\w@$](?:\W+[\w@$](?![\w@])){2}")
EDGES = ".,;:!?\"'()[]{}«»“”„…"
EDGES_BUT = EDGES.replace("!", "")


def _fold(m: re.Match) -> str:
    return m.group().translate(FOLDED)


class _Folded(dict):
    """Plain letters of a sign, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).translate(HIDDEN).translate(PLAIN)
        self[code] = out = ACCENTS.sub("", unicodedata.normalize("NFKD", c))
        return out


FOLDED = _Folded()
ACCENTS = re.compile("[\u0300-\u036f]+")
FOREIGN = re.compile(r"[^\x00-\x7f]+")


def folded(text: str) -> str:
    """Lower case, no accents. In a word that mixes scripts, look-alike letters as Latin ones; other scripts stay."""
    text = text.lower()
    if text.isascii():
        return text
    if MIXED.search(text):
        text = TOKEN.sub(lambda m: m.group().translate(LOOKALIKE) if MIXED.search(m.group()) else m.group(), text)
    return FOREIGN.sub(_fold, text)


def mended(text: str) -> str:
    """Words whose UTF-8 was read as an 8-bit charset."""

    def mend(m: re.Match) -> str:
        w = m.group()
        for charset in ("cp1252", "cp1250", "latin-1", "iso8859-2"):
            try:
                return w.encode(charset).decode("utf-8")
            except UnicodeError:
                continue
        return w

    return re.sub(r"\S*[ÃÂÄÅĹĂ]\S*", mend, text)


# ---- the character language model


def codes(word: str) -> list[int]:
    return [ord(c) - 96 for c in word]


def count_table(words: Counter) -> np.ndarray:
    """Counts of letter sequences of length ORDER, borders included."""
    out = np.zeros(TABLE, np.int64)
    for w, n in words.items():
        k = 0
        for c in [*codes(w), 0]:
            k = (k * A + c) % TABLE
            out[k] += n
    return out


def model_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: the model's counts over the words of all documents; at most A**ORDER rows."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        words: Counter = Counter()

        def settle() -> None:
            plain: Counter = Counter()
            for w, n in words.items():
                w = folded(w.strip(EDGES))
                if w.isascii() and w.isalpha():
                    plain[w] += n
            np.add(total, count_table(plain), out=total)
            words.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(t.split())
            if len(words) > 100_000:
                settle()
        settle()
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    need = docs.select(F.col(text).cast("string").alias("t")).filter("length(t) > 0")
    return need.mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after the ORDER - 1 before it, smoothed with the shorter contexts."""
    c = counts.reshape((A,) * ORDER).astype(np.float64)
    p = np.full(A, 1 / A)
    for k in range(ORDER - 1, -1, -1):
        part = c.sum(axis=tuple(range(k))) if k else c
        total = part.sum(axis=-1, keepdims=True)
        p = (part + 2.0 * p) / (total + 2.0)
    return np.log(p).astype(np.float32)


def _spread(to: np.ndarray, values: np.ndarray, rest: float) -> np.ndarray:
    """The values at their contexts, ``rest`` at the others."""
    out = np.full(CONTEXTS, rest, values.dtype)
    out[to] = values
    return out


class Decoder:
    """Viterbi search over character lattices, with the best word beginning of every letter context.

    While few contexts are open they are kept in a dict; the steps from there on, if it gets more
    (masks), are maxima over arrays of all contexts. Both are exact.
    """

    TWICE = -6.0  # log chance of a letter set twice for once
    FEW = 300  # contexts times strings of a step, beyond which arrays are faster
    BREAK = -4.0  # log chance of a word border between spaced letters, beyond the model's own

    def __init__(self, model: np.ndarray, telling: frozenset[str] = frozenset()) -> None:
        self.flat = model.reshape(CONTEXTS, A)
        self.telling = telling
        self.singled = frozenset(TWICE.sub(r"\1", w) for w in telling)
        self.known: dict[str, str] = {}
        self.plain: set[str] = set()

    def lattice(self, seen: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each sign of a folded token the strings it may stand for, with their log chances."""
        out: list[list[tuple[str, float]]] = []
        k = 0
        while k < len(seen):
            c = seen[k]
            n = 1
            while k + n < len(seen) and seen[k + n] == c:
                n += 1
            if c in WILD:
                out += [[(x, -3.3) for x in ANY]] * n
            elif c == "?":
                out += [[("", -0.1)]] * n
            else:
                letters = c if c in ANY else LEET.get(c, "")
                if not letters:
                    k += n
                    continue
                if n == 2:
                    out.append([(x + y, 0.0 if c in ANY else -0.4) for x in letters for y in letters] + [(x, self.TWICE) for x in letters])
                elif n >= 3:
                    out.append([(x * m, -1.0 * m) for x in letters for m in (1, 2)])
                else:
                    out += [[(x, 0.0 if c in ANY else -0.2) for x in letters]] * n
            k += n
            if spaced and k < len(seen):
                out.append([("", 0.0), (" ", self.BREAK)])
        return out

    def decode(self, seen: str, spaced: bool = False) -> str:
        key = f"{spaced:d}{seen}"
        if key in self.known:
            return self.known[key]
        best = self.search(self.lattice(seen, spaced))
        if len(self.known) < 100_000:
            self.known[key] = best
        return best

    def search(self, steps: list[list[tuple[str, float]]]) -> str:
        """The most probable word of a lattice."""
        open_: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for k, step in enumerate(steps):
            if len(open_) * len(step) > self.FEW:
                return self._search_all(open_, steps[k:])
            new: dict[int, tuple[float, str]] = {}
            for ctx, (score, word) in open_.items():
                for text, chance in step:
                    s, x = score + chance, ctx
                    for ch in text:
                        code = 0 if ch == " " else ord(ch) - 96
                        s += float(self.flat[x, code])
                        x = (x * A + code) % CONTEXTS if code else 0
                    if x not in new or s > new[x][0]:
                        new[x] = (s, word + text)
            open_ = new
        return max(open_.items(), key=lambda kv: kv[1][0] + float(self.flat[kv[0], 0]))[1][1]

    def _search_all(self, start: dict[int, tuple[float, str]], steps: list[list[tuple[str, float]]]) -> str:
        """The search from the open contexts on, over arrays of all contexts."""
        score = np.full(CONTEXTS, -np.inf)
        for ctx, (s, _) in start.items():
            score[ctx] = s
        every = np.arange(CONTEXTS)
        back: list[tuple[np.ndarray, np.ndarray]] = []
        for step in steps:
            new = np.full(CONTEXTS, -np.inf)
            before, chosen = np.zeros(CONTEXTS, np.int32), np.zeros(CONTEXTS, np.int8)

            def put(to: np.ndarray, s: np.ndarray, come: np.ndarray, option: int, new=new, before=before, chosen=chosen) -> None:
                better = s > new[to]
                at = to[better]
                new[at], before[at], chosen[at] = s[better], come[better], option

            for option, (text, chance) in enumerate(step):
                if text == "":
                    put(every, score + chance, every, option)
                elif text == " ":
                    s = score + self.flat[:, 0]
                    put(every[:1], s[[s.argmax()]] + chance, s.argmax()[None], option)
                else:
                    s, come = score, every
                    for code in codes(text):  # contexts that differ in their first letter only come together
                        s = (s + self.flat[:, code]).reshape(A, -1)
                        first = s.argmax(axis=0)
                        low = every[: A * A]
                        to, s, come = low * A + code, s[first, low], come[first * A * A + low]
                        s, come = _spread(to, s, -np.inf), _spread(to, come, 0)
                    to = np.flatnonzero(s > -np.inf)
                    put(to, s[to] + chance, come[to], option)
            score = new
            back.append((before, chosen))
        at = int((score + self.flat[:, 0]).argmax())
        out = []
        for step, (before, chosen) in zip(reversed(steps), reversed(back), strict=True):
            out.append(step[chosen[at]][0])
            at = int(before[at])
        return start[at][1] + "".join(reversed(out))

    def suspicious(self, tokens: list[str]) -> set[str]:
        """Tokens that may be disguised; what was found plain before is not looked at again."""
        new = set(tokens) - self.plain
        bad = {t for t in new if SUSPECT.search(t) or any(map(self.meant, {f := folded(t).strip(EDGES_BUT), *JOINT.split(f.strip(EDGES))}))}
        if len(self.plain) < 300_000:
            self.plain |= new - bad
        return bad

    def meant(self, core: str) -> str | None:
        """The telling word that a folded word with signs at an end, or doubled letters, stands for; None if it can be meant as it is.

        A digit is kept or read as a letter: it is read if that gives a telling word and the letters
        alone give none. A doubled letter stays if the language model finds that likelier.
        """
        if END.search(core):
            body = core.rstrip(SIGNS)
            if len(body) < 2 or body in self.telling or not body.isalpha():
                return None
        elif not START.search(core) and not (TWICE.search(core) and core not in self.telling and TWICE.sub(r"\1", core) in self.singled):
            return None
        best = self.decode(core)
        return best if best in self.telling else None

    def joined(self, signs: str) -> str:
        """Signs that were set apart; digits at the end stay unless only with them it is a telling word."""
        end = re.search(r"\d*$", signs).group()
        alone = self.decode(signs[: len(signs) - len(end)], True)
        if end and alone not in self.telling and (best := self.decode(signs, True)) in self.telling:
            return best
        return alone + end

    def word(self, w: str) -> str:
        """One folded token with its disguised part decoded."""
        if (best := self.meant(core := w.strip(EDGES_BUT))) or (best := self.meant(core := w.strip(EDGES))):
            return w.replace(core, best, 1)
        if not core or ".example" in core or "//" in core or re.fullmatch(r"\d+[a-z]{1,3}", core):
            return w
        head, tail = w[: w.index(core)], w[w.index(core) + len(core) :]
        if len(re.findall(r"[.\-_*'|]", core)) >= 2 and re.fullmatch(r"[\w@$](?:[.\-_*'|]+[\w@$])+", core):
            signs = re.sub(r"[.\-_*'|]+", "", core)
            return f"{head}{self.joined(signs)}{tail}"
        end = m.group(1) if (m := re.match(r"[a-z]*?[a-z]{2}([0-9_]+)$", core)) else ""
        body = core[: len(core) - len(end)]
        out = []
        for p in JOINT.split(body):
            disguised = any(c in ANY for c in p) and (not p.isalpha() or re.search(r"(\w)\1\1", p))
            out.append(self.meant(p) or (self.decode(p) if disguised else p))
        return head + "".join(out) + end + tail

    def restore(self, text: str) -> str:
        """The text with its disguised words decoded; other words as they are, folded."""
        if "&" in text:
            text = html.unescape(text)
        tokens = text.split()
        bad = self.suspicious(tokens)
        apart = APART.search(text)
        if not bad and not apart:
            return folded(text)
        fixed = {t: self.word(folded(mended(t))) for t in bad}
        if fixed:
            text = TOKEN.sub(lambda m: fixed.get(m.group(), m.group()), text)
        text = folded(text)
        if not apart:
            return text

        def spaced(m: re.Match) -> str:
            signs = re.sub(r"[ .\-_*'|]+", "", m.group())
            if not any(c in ANY for c in signs):
                return m.group()
            return f" {self.joined(signs)} "

        return SPACED.sub(spaced, text)


# ---- the operator


def trained_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The character model of all documents; its counts (at most A**ORDER, 531,441) are summed up on the cluster."""
    counts = np.zeros(TABLE, np.int64)
    t = model_counts(docs, text).toArrow()
    counts[t["gram"].to_numpy()] = t["n"].to_numpy()
    return language_model(counts)


def restored(docs: DataFrame, model: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``restored``: the text with its disguised words decoded, folded; NULL becomes empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the corpus

    @F.arrow_udf("string")
    def restore(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        d = Decoder(shared.value)
        for c in col:
            yield pa.array([d.restore(t) if t else "" for t in c.to_pylist()], pa.string())

    return docs.select(*keep, restore(F.col(text).cast("string")).alias("restored"))


def reviewed(docs: DataFrame, labels: DataFrame, max_reviews: int = 8000, text: str = "text") -> DataFrame:
    """doc_id, text, toxic of at most about ``max_reviews`` reviewed documents, the bound of the fit.

    Up to half of the bound are positive reviews, the rest negative ones, each chosen by a hash of
    doc_id. Of a document reviewed several times the mean counts; NULL reviews and reviews without a
    document are left out.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("d")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    pos = min(n.get(1, 0), max_reviews // 2)
    share = {1: pos / max(1, n.get(1, 0)), 0: (max_reviews - pos) / max(1, n.get(0, 0))}
    u = F.pmod(F.xxhash64(F.lit("review"), "d"), F.lit(1_000_000)) / 1e6
    some = one.filter(u < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("d")).drop("d")  # at most max_reviews rows


def fitted(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_reviews: int = 8000, text: str = "text") -> ClauseModel:
    """Weights of clauses, from the bounded sample of reviews (see :func:`reviewed`), fitted in one task; weights that are not 0 come to the driver."""
    need = restored(reviewed(docs, labels, max_reviews, text), model, keep=("doc_id", "toxic")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # at most about max_reviews documents
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("restored", "ascending")])
        m = fit(t["restored"].to_pylist(), t["toxic"].to_numpy())
        at = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([sorted(m.telling)]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([m.weights[at]], pa.list_(pa.float32()))], ["bias", "telling", "at", "weight"])

    got = need.mapInArrow(run, "bias double, telling array<string>, at array<int>, weight array<float>").toArrow()
    m = ClauseModel()
    if got.num_rows:
        m.bias, m.telling = got["bias"][0].as_py(), frozenset(got["telling"][0].as_py())
        m.weights[got["at"][0].values.to_numpy()] = got["weight"][0].values.to_numpy()
    return m


def scored(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source"), model: np.ndarray | None = None, scorer: ClauseModel | None = None, max_reviews: int = 8000) -> DataFrame:
    """``keep`` and ``score`` (0..1) of every document: the highest score of any of its clauses; 0.5 and more counts as abusive.

    ``labels``: doc_id, toxic (0, 1 or NULL), reviews to which the scorer is fitted unless one is
    given; ``max_reviews`` bounds how many are used. ``model`` and ``scorer`` can be kept and passed in
    again. A NULL or empty text scores 0, as does everything where no positive or no negative review
    exists. Whole texts are read. No shuffle but for the model's counts; the model (2 MB) and the
    weights (1 MB) are broadcast, whatever the corpus. Equal texts score alike. Extra columns are ignored.
    """
    model = trained_model(docs, text) if model is None else model
    if scorer is None:
        if labels is None:
            raise ValueError("labels or a scorer are needed")
        scorer = fitted(docs, labels, model, max_reviews, text)
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    @F.arrow_udf("double")
    def score(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lm, weights = shared.value
        d, s = Decoder(lm, weights.telling), Scorer(weights)
        for c in col:
            texts = c.to_pylist()
            for k in range(0, len(texts), 500):
                texts[k : k + 500] = s.scores([d.restore(t) if t else "" for t in texts[k : k + 500]]).tolist()
            yield pa.array(texts, pa.float64())

    return docs.select(*keep, score(F.col(text).cast("string")).alias("score"))


def abusive(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.filter(F.col("score") >= threshold)


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source, docs, abusive, rate, mean_score; a NULL source is a group of its own."""
    hit = (F.col("score") >= threshold).cast("int")
    return scores.groupBy("source").agg(F.count("*").alias("docs"), F.sum(hit).alias("abusive"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
