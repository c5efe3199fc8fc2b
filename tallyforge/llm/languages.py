"""Languages of texts and of their parts: averaged hashed subword embeddings under a linear softmax.

A text is cut into parts: sentences, and lines or windows of text without an end mark. A part is the mean of the
vectors of its hashed character n-grams; a linear softmax over that mean gives the languages. Vectors and weights are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled texts, a second time without
the sentences whose label the first model contradicts; a temperature and a threshold below which a part is given no
language are fitted on sentences held out of the training.
"""

from __future__ import annotations

import dataclasses
import hashlib
import html
import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Other notations of the codes of lang_codes (ISO 639-2 and own names); English names are in lang_codes.
NOTATIONS = {
    "en": ["eng", "english"],
    "es": ["spa", "español", "espanol", "castellano"],
    "de": ["deu", "ger", "deutsch"],
    "fr": ["fra", "fre", "français", "francais"],
    "pt": ["por", "português", "portugues"],
    "it": ["ita", "italiano"],
    "nl": ["nld", "dut", "nederlands", "flemish", "vlaams"],
    "ja": ["jpn", "日本語", "nihongo", "jp"],
}
#: Words whose point ends no sentence (single letters need no entry).
ABBREVIATIONS = ["Jr", "Sr", "St", "Mr", "Mrs", "Ms", "Dr", "Prof", "vs", "No", "Sra", "Dra", "Mme", "Mlle", "bzw", "usw", "Nr", "Sig", "Dott", "núm", "pág", "dhr", "mevr", "bijv"]
BUCKETS, DIM, GRAMS = 1 << 16, 16, (1, 2, 3, 4)
PER_LABEL = 400  # different labelled texts per language in the sample, whatever the table's size
PER_TEXT = 12  # sentences of each of them, spread over the text; a part has at most WINDOW characters
MAX_PER_LABEL = 4_000  # sentences per language that are trained on
MIN_LETTERS = 12  # letters of a part (kana and ideographs count three)
WINDOW = 1_000  # characters of a part; longer runs without an end mark are cut at blanks
PIECE = 200_000  # characters looked at at once
EPOCHS, RATE, BATCH = 4, 0.5, 128
LEAST_STEPS = 400  # small samples are gone through more often

MARKUP = re.compile(r"<[A-Za-z/!][^<>]*>|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|\w{2,31});|[\x00-\x7f]?[^\x00-\x7f]+", re.ASCII)
LETTER, UPPER, WIDE, SPACE, END, WIDE_END, CLOSER, RAW, ASCII, NOISE, NEWLINE, DIGIT, WORDY = (1 << k for k in range(13))
FULL_WIDTH_SIGNS = "！？（），：；"  # left as they are: their compatibility forms would read as marks of other scripts


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Signs of each code of the basic plane, and its lower case; the last entry is for all other codes."""
    sign, lower = np.zeros(0x10001, np.uint16), np.arange(0x10001, dtype=np.uint32)
    for c in range(0x10000):
        x, s = chr(c), 0
        if x.isalnum():
            s |= WORDY | (DIGIT if x.isdecimal() else LETTER) | UPPER * x.isupper()
            lower[c] = ord(x.lower()[0])
        s |= SPACE * x.isspace() | ASCII * (0x21 <= c <= 0x7E) | WIDE * (0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF)
        if c > 0x7F and x not in FULL_WIDTH_SIGNS and not 0xD800 <= c < 0xE000 and (unicodedata.category(x) in ("Mn", "Cf") or unicodedata.normalize("NFKC", x) != x):
            s |= RAW
        sign[c] = s
    for xs, s in ((".!?", END), ("。！？", WIDE_END), ("\"'”’»«」』)）]", CLOSER), ("<&", RAW), ("#@_=\\0123456789", NOISE), ("\r\n", NEWLINE), ("_", WORDY)):
        for x in xs:
            sign[ord(x)] |= s
    return sign, lower


SIGN, LOWER = _kinds()


def normalised(text: str) -> tuple[str, np.ndarray]:
    """(text, places): composed form without tags, entities and unseen characters; places gives each character's origin."""
    out, places, at = [], [], 0

    def put(s: str, begin: int, end: int) -> None:
        if s:
            out.append(s)
            places.append(np.arange(begin, end) if len(s) == end - begin else np.full(len(s), begin))

    for m in MARKUP.finditer(text):
        x, a, b = m.group(), *m.span()
        put(text[at:a], at, a)
        at = b
        if x[0] == "<" and x[-1] == ">":
            put(" ", a, b)
        elif x[0] == "&" and x[-1] == ";" and x.isascii():
            put(unicodedata.normalize("NFKC", html.unescape(x)), a, b)
        elif unicodedata.is_normalized("NFKC", x) and not (SIGN[[min(ord(c), 0x10000) for c in x]] & RAW).any():
            put(x, a, b)
        else:
            k = 0
            while k < len(x):  # a character with the marks after it
                e = k + 1
                while e < len(x) and (unicodedata.combining(x[e]) or x[e] in "ﾞﾟ"):
                    e += 1
                if x[k] in FULL_WIDTH_SIGNS:
                    put(x[k:e], a + k, a + e)
                elif unicodedata.category(x[k]) != "Cf":
                    put(unicodedata.normalize("NFKC", x[k:e]), a + k, a + e)
                k = e
    put(text[at:], at, len(text))
    places.append(np.array([len(text)]))
    return "".join(out), np.concatenate(places)


@dataclasses.dataclass
class Parts:
    """Parts of texts in their order: whose they are, where, whether whole sentences, and what the model sees of them.

    That is lower case words between blanks, without numbers and signs of code or links. Words with a capital are
    mostly names and are left out where enough other words remain; of a part in kana or ideographs only those are left.
    """

    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    whole: np.ndarray
    codes: np.ndarray
    starts: np.ndarray

    def text(self, k: int) -> str:
        return self.codes[self.starts[k] : self.starts[k + 1]].tobytes().decode("utf-32-le", "replace")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts between line ends: as one text, its codes and their signs, and where each text begins."""
    joined = "\n" + "\n".join(texts) + "\n"
    code = _codes(joined)
    return joined, code, SIGN[np.minimum(code, 0x10000)], 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def _spread(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    d = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(d > 0), np.flatnonzero(d < 0)


def _sum(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int32)])
    return total[ends] - total[begins]


def parts(texts: list[str]) -> Parts:
    """The parts of whole texts. A part is a sentence (at least MIN_LETTERS letters and an end mark), or a line or window.

    Lines and windows count from MIN_LETTERS letters on; a text with none of either is one part if it has a letter.
    """
    found = []
    pending: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            found.append(_parts_of(pending))
        pending.clear()
        size = 0

    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > PIECE:  # cut where a line, a sentence or a word ends
                end = next((c + 1 for c in (text.rfind(x, at + PIECE // 2, at + PIECE) for x in ("\n", ". ", "。", " ")) if c > 0), at + PIECE)
            pending.append((k, at, text[at:end]))
            size += end - at
            at = end
            if size >= PIECE // 2:
                flush()
    flush()
    if not found:
        none = np.zeros(0, np.int64)
        return Parts(none, none, none, none.astype(bool), none.astype(np.uint32), np.zeros(1, np.int64))
    lengths = np.concatenate([[0], np.cumsum([len(p.codes) for p in found])])
    starts = np.concatenate([*[p.starts[:-1] + n for p, n in zip(found, lengths)], lengths[-1:]])
    return Parts(*[np.concatenate([getattr(p, x) for p in found]) for x in ("owner", "begin", "end", "whole", "codes")], starts)


def _parts_of(pieces: list[tuple[int, int, str]]) -> Parts:
    texts = [x[2] for x in pieces]
    joined, code, sign, first = _joined(texts)
    maps: dict[int, np.ndarray] = {}
    raw = np.flatnonzero(sign & RAW)
    if len(raw):
        for k in np.unique(np.searchsorted(first, raw, "right") - 1).tolist():
            texts[k], maps[k] = normalised(texts[k])
        joined, code, sign, first = _joined(texts)
    n = len(code)

    def has(bit: int) -> np.ndarray:
        return (sign & bit) != 0

    # end marks: not the points of initials, abbreviations and decimal fractions
    dots = np.flatnonzero(code == 46)
    before, after = sign[np.maximum(dots - 1, 0)], sign[np.minimum(dots + 1, n - 1)]
    inner = ((before & DIGIT) != 0) & ((after & DIGIT) != 0) | ((before & LETTER) != 0) & ((sign[np.maximum(dots - 2, 0)] & WORDY) == 0)
    sign[dots[inner]] &= ~np.uint16(END)
    for word in ABBREVIATIONS:
        at = joined.find(word + ".")
        while at >= 0:
            if not sign[at - 1] & WORDY:
                sign[at + len(word)] &= ~np.uint16(END)
            at = joined.find(word + ".", at + 1)

    space, closer = has(SPACE), has(CLOSER)
    open_places = np.flatnonzero(~closer)
    runs, run_ends = _spread(space)
    mark = open_places[np.maximum(np.searchsorted(open_places, runs) - 1, 0)]
    cut = ((sign[mark] & END) != 0) & (mark < runs) | (_sum(has(NEWLINE), runs, run_ends) > 0)
    wide_end = np.flatnonzero(has(WIDE_END))
    solid = np.append(np.flatnonzero(~space), n)
    past = np.append(open_places, n)
    wide_cut = solid[np.searchsorted(solid, past[np.searchsorted(past, wide_end + 1)])]
    cuts = np.unique(np.concatenate([first, run_ends[cut], wide_cut]))
    cuts = cuts[cuts <= n]
    long = np.flatnonzero(np.diff(cuts) > WINDOW)
    if len(long):
        more = []
        for k in long.tolist():
            at, end = int(cuts[k]), int(cuts[k + 1])
            step = -(-(end - at) // -(-(end - at) * 10 // (9 * WINDOW)))  # windows of about one length
            while end - at > WINDOW:
                blank = run_ends[max(np.searchsorted(run_ends, at + step, "right") - 1, 0)] if len(run_ends) else 0
                at = int(blank) if at < blank <= at + step else at + step
                more.append(at)
        cuts = np.unique(np.concatenate([cuts, more]))
    begin, end = cuts[:-1], cuts[1:]

    # tokens of ASCII signs that hold a sign of code, links or a number are noise
    letter, wide = has(LETTER), has(WIDE)
    spoils = np.flatnonzero(has(NOISE) | (code == 58))
    if len(spoils):
        link = code[spoils] == 58
        bad = spoils[~link]
        colon = spoils[link & (spoils + 2 < n) & (spoils > 0)]
        colon = colon[(code[np.minimum(colon + 1, n - 1)] == 47) & (code[np.minimum(colon + 2, n - 1)] == 47) & ((code[colon - 1] | 32 == ord("p")) | (code[colon - 1] | 32 == ord("s")))]
        bad = np.concatenate([bad, colon])
        if len(bad):
            a, b = _spread(has(ASCII))
            hit = np.unique(np.searchsorted(a, bad, "right") - 1)
            d = np.zeros(n + 1, np.int8)
            d[a[hit]] += 1
            d[b[hit]] -= 1
            letter &= np.cumsum(d[:-1], dtype=np.int8) == 0
    last_places = np.flatnonzero(~(closer | space))
    last = last_places[np.maximum(np.searchsorted(last_places, end) - 1, 0)] if len(last_places) else np.zeros(len(end), int)
    marked = (last >= begin) & (last < end) & ((sign[np.minimum(last, n - 1)] & (END | WIDE_END)) != 0)
    words, word_ends = _spread(letter)
    of_word = np.searchsorted(begin, words, "right") - 1
    n_wide = _sum(wide, begin, end)
    letters = np.bincount(of_word, word_ends - words, len(begin)) + 2 * n_wide
    whole = marked & (letters >= MIN_LETTERS) & ((np.bincount(of_word, minlength=len(begin)) >= 3) | (n_wide >= 4))
    owner = np.searchsorted(first, begin, "right") - 1
    seen = whole | (letters >= MIN_LETTERS)
    silent = np.bincount(owner[seen], minlength=len(texts)) == 0
    if silent.any():  # the texts without a part: all of each as one
        drop = silent[owner]
        some = np.bincount(owner[drop], letters[drop], len(texts)) > 0
        keep = ~drop | (np.diff(np.concatenate([[-1], owner])) != 0)  # their first cut stands for all
        begin, owner, whole, seen = begin[keep], owner[keep], whole[keep], seen[keep] | (drop & some[owner])[keep]
        n_wide = np.where(silent[owner], np.bincount(np.searchsorted(first, np.flatnonzero(wide), "right") - 1, minlength=len(texts))[owner], n_wide[keep])
        end = np.append(begin[1:], n)
        of_word = np.searchsorted(begin, words, "right") - 1

    # what the model sees: kept words, each after a blank, and a blank after each part
    in_wide = n_wide >= 4
    long_word = word_ends - words
    common = (sign[words] & UPPER) == 0
    enough = np.bincount(of_word[common], long_word[common], len(begin)) >= MIN_LETTERS
    kept_word = seen[of_word] & ~in_wide[of_word] & (common | ~enough[of_word])
    keep, opens = np.zeros(n, bool), np.zeros(n, bool)
    d = np.zeros(n + 1, np.int8)
    d[words[kept_word]] += 1
    d[word_ends[kept_word]] -= 1
    keep = np.cumsum(d[:-1], dtype=np.int8) > 0
    opens[words[kept_word]] = True
    places = np.flatnonzero(wide)
    if len(places):
        of = np.searchsorted(begin, places, "right") - 1
        mine = in_wide[of] & seen[of]
        places, of = places[mine], of[mine]
        keep[places] = True
        opens[places[np.diff(np.concatenate([[-1], of])) != 0]] = True
    chars = np.flatnonzero(keep)
    ordinal = np.cumsum(seen) - 1
    part_of = ordinal[np.searchsorted(begin, chars, "right") - 1]
    count = int(seen.sum())
    words_before = np.cumsum(opens[chars])
    out = np.full(len(chars) + int(opens.sum()) + count, 32, np.uint32)
    out[np.arange(len(chars)) + words_before + part_of] = LOWER[np.minimum(code[chars], 0x10000)] if len(chars) else 0
    per_part = np.bincount(part_of, minlength=count) + np.bincount(part_of, opens[chars], count).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(per_part)])

    owner, begin, end, whole = owner[seen], begin[seen], end[seen], whole[seen]
    b, e = begin - first[owner], np.minimum(end - first[owner], np.array([len(t) for t in texts])[owner])
    for k, places in maps.items():
        mine = owner == k
        b[mine], e[mine] = places[b[mine]], places[e[mine]]
    base, row = np.array([x[1] for x in pieces]), np.array([x[0] for x in pieces])
    return Parts(row[owner], b + base[owner], e + base[owner], whole, out, starts)


def hashed(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: (bucket, inside) by where an n-gram begins; inside: it crosses no part's end."""
    code = codes.astype(np.uint64)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(code))
    rolling = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            return
        rolling = rolling[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            yield (((rolling + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int32), left[: len(rolling)] >= n


def grams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): hashed n-grams of the parts one after the other, and where each part's begin."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    every = [(bucket[inside], owner[: len(bucket)][inside]) for bucket, inside in hashed(codes, starts)]
    if not every:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    o = np.concatenate([x[1] for x in every])
    order = np.argsort(o, kind="stable")
    return np.concatenate([x[0] for x in every])[order], np.searchsorted(o[order], np.arange(len(starts)))


@dataclasses.dataclass
class Model:
    langs: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def means(self, bucket: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(starts)
        out = np.zeros((len(n), self.vectors.shape[1]), np.float32)
        full = n > 0
        if full.any():
            out[full] = np.add.reduceat(self.vectors[bucket], starts[:-1][full], axis=0) / n[full][:, None]
        return out

    def logits(self, parts: Parts, pick: np.ndarray | None = None) -> np.ndarray:
        """The logits of the parts (of those picked): means of the vectors' own logits, as both are linear."""
        table = np.concatenate([self.vectors @ self.weights, np.zeros((1, len(self.langs)), np.float32)])
        out = np.empty((len(parts.starts) - 1, len(self.langs)), np.float32)
        at = 0
        while at < len(out):  # a bounded number of characters at once
            end = max(at + 1, int(np.searchsorted(parts.starts, parts.starts[at] + 50_000, "right")) - 1)
            codes, starts = parts.codes[parts.starts[at] : parts.starts[end]], parts.starts[at : end + 1] - parts.starts[at]
            total, count = np.zeros((len(codes), len(self.langs)), np.float32), np.zeros(end - at)
            for n, (bucket, inside) in zip(GRAMS, hashed(codes, starts)):
                total[: len(bucket)] += table[np.where(inside, bucket, BUCKETS)]
                count += np.maximum(np.diff(starts) - n + 1, 0)
            out[at:end] = np.add.reduceat(total, starts[:-1]) / np.maximum(count, 1)[:, None]
            at = end
        return (out if pick is None else out[pick]) + self.bias

    def probabilities(self, parts: Parts) -> np.ndarray:
        return softmax(self.logits(parts) / self.temperature)

    def saved(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, langs=np.array(self.langs), vectors=self.vectors, weights=self.weights, bias=self.bias, fitted=np.array([self.temperature, self.threshold]))
        return to.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return Model([str(l) for l in x["langs"]], x["vectors"], x["weights"], x["bias"], *map(float, x["fitted"]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True) if len(z) else e


def fit(bucket: np.ndarray, starts: np.ndarray, pick: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Train vectors and softmax on the picked parts by minibatch gradient descent, with a rate falling to zero."""
    rng = np.random.default_rng(seed)
    model = Model(langs, rng.normal(0, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    bucket, n = bucket.astype(np.uint16), np.diff(starts)  # short integers are sorted by their digits
    pick = pick[n[pick] > 0]
    balance = len(pick) / np.maximum(1, np.bincount(labels[pick], minlength=len(langs)) * len(langs))
    batches = max(1, -(-len(pick) // BATCH))
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(pick)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            own = np.concatenate([bucket[starts[i] : starts[i + 1]] for i in some])
            h = model.means(own, np.concatenate([[0], np.cumsum(n[some])]))
            p = softmax(h @ model.weights + model.bias)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= np.clip(balance[labels[some]], 0.2, 5)[:, None]
            back = ((p @ model.weights.T) / n[some][:, None]).astype(np.float32)
            model.weights -= rate * 20 * (h.T @ p).astype(np.float32) / len(some)
            model.bias -= rate * p.mean(axis=0).astype(np.float32)
            order_of = np.argsort(own, kind="stable")
            sorted_own = own[order_of]
            first = np.flatnonzero(np.r_[True, sorted_own[1:] != sorted_own[:-1]])
            model.vectors[sorted_own[first]] -= rate * np.add.reduceat(back[np.repeat(np.arange(len(some)), n[some])[order_of]], first, axis=0)
    return model


def calibrate(model: Model, z: np.ndarray, labels: np.ndarray, wanted: float = 0.997) -> None:
    """Fit temperature (log loss) and threshold (the lowest whose accepted sentences reach the wanted precision)."""
    if not len(z):
        return
    grid = np.geomspace(0.05, 5, 40)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-9)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= wanted)
    model.threshold = float(np.clip(top[order][good[-1]] if len(good) else 0.9, 0.5, 0.9))


def label_code(label: F.Column, names: dict[str, str]) -> F.Column:
    """The code that a delivered label means, in whatever notation; NULL for a missing label or a placeholder."""
    means = {x: code for code in names for x in [code, names[code].lower(), *NOTATIONS.get(code, [])]}
    table = F.create_map(*[F.lit(x) for pair in means.items() for x in pair])
    text = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.regexp_extract(text, r"^(\w{2,3})[-_.@]", 1)))


def labelled_sentences(documents: DataFrame, names: dict[str, str], per_label: int = PER_LABEL) -> pa.Table:
    """(code, place, sentence): what the model sees of sentences of up to `per_label` different texts per language.

    Texts are chosen by a hash of the text, and copies of a text count once, so a text that makes up a third of the
    corpus is one of them. Of each, PER_TEXT sentences spread over the whole text are taken, with at most WINDOW
    characters each: what reaches the driver is bounded by per_label x PER_TEXT x WINDOW characters per language.
    """
    rows = documents.select("text", label_code(F.col("lang"), names).alias("code")).filter("code is not null and length(text) > 0")
    rows = rows.withColumn("chance", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.approx_count_distinct("chance").alias("n")).collect()}  # a row per language
    if not counts:
        return pa.table({"code": pa.array([], pa.string()), "place": pa.array([], pa.int32()), "sentence": pa.array([], pa.string())})
    share = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, int(min(1.0, 1.3 * per_label / max(1, n)) * (1 << 40)))])
    picked = rows.filter(F.col("chance") <= share[F.col("code")]).distinct()
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("chance", "text"))).filter(F.col("place") <= per_label)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = parts(batch.column("text").to_pylist())
            k = np.flatnonzero(found.whole)
            nth = np.arange(len(k)) - np.searchsorted(found.owner[k], found.owner[k])
            n = np.bincount(found.owner[k], minlength=batch.num_rows)[found.owner[k]]
            k = k[(nth * PER_TEXT) // np.maximum(n, PER_TEXT) != ((nth - 1) * PER_TEXT) // np.maximum(n, PER_TEXT)]
            own = pa.array(found.owner[k])
            yield pa.RecordBatch.from_arrays([batch.column("code").take(own), batch.column("place").take(own), pa.array([found.text(i) for i in k.tolist()], pa.string())], ["code", "place", "sentence"])

    return picked.select("code", "place", "text").mapInArrow(seen, "code string, place int, sentence string").toArrow().sort_by([("code", "ascending"), ("place", "ascending"), ("sentence", "ascending")])


def train(documents: DataFrame, names: dict[str, str], per_label: int = PER_LABEL, folder: str | None = None) -> Model:
    """A calibrated model from the labelled sentences of a bounded sample (`labelled_sentences`).

    Every fifth text of the sample is held out for calibration. A table without labelled text gives a model that
    rejects everything. With `folder` (on the driver) the model is kept there under the sample's fingerprint, and
    a model of the same sample is read instead of trained again.
    """
    langs = sorted(names)
    sample = labelled_sentences(documents, names, per_label)
    sentences = sample["sentence"].to_pylist()
    y = np.array([langs.index(c) for c in sample["code"].to_pylist()], int)
    if not len(y):
        return Model(langs, np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32), threshold=2.0)
    if folder:
        from pathlib import Path

        mark = hashlib.sha256(repr((langs, PER_LABEL, BUCKETS, DIM, GRAMS, EPOCHS, RATE, BATCH)).encode())
        for code, sentence in zip(sample["code"].to_pylist(), sentences):
            mark.update(f"{code}\n{sentence}\n".encode())
        kept = Path(folder, f"languages-{mark.hexdigest()}.npz")
        if kept.exists():
            return Model.loaded(kept.read_bytes())
    held_out = sample["place"].to_numpy() % 5 == 0
    codes, ends = _codes("".join(sentences)), np.cumsum([len(s) for s in sentences])
    seen = Parts(y, y, y, y > -1, codes, np.concatenate([[0], ends]))
    bucket, starts = grams(seen.codes, seen.starts)
    rng = np.random.default_rng(3)
    keep = np.concatenate([rng.permutation(np.flatnonzero((y == c) & ~held_out))[:MAX_PER_LABEL] for c in range(len(langs))])
    model = fit(bucket, starts, keep, y, langs, epochs=2)
    for epochs in (2, EPOCHS):  # twice, as labels that are wrong more often than right for a language blur the first model
        fair = model.logits(seen).argmax(axis=1) == y
        model = fit(bucket, starts, keep[fair[keep]], y, langs, epochs=epochs)
    z = model.logits(seen)
    test = np.flatnonzero(held_out & ((z.argmax(axis=1) == y) | fair))
    calibrate(model, z[test], y[test])
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        kept.write_bytes(model.saved())
    return model


SEGMENTS = "doc_id bigint, segment int, begin int, end int, lang string, confidence double, n_sentences int, label string"


def _segments(documents: DataFrame, names: dict[str, str], model: Model | None) -> DataFrame:
    model = model or train(documents, names)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats, whatever the corpus

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            p = parts(batch.column("text").to_pylist())
            if not len(p.owner):
                continue
            q = model.probabilities(p)
            best = q.argmax(axis=1)
            sure = q[np.arange(len(best)), best].astype(float)
            lang = np.where(sure >= model.threshold, best, -1)
            at = np.flatnonzero(np.concatenate([[True], (p.owner[1:] != p.owner[:-1]) | (lang[1:] != lang[:-1])]))
            own, n = p.owner[at], np.diff(np.append(at, len(best)))
            columns = [
                batch.column("doc_id").take(pa.array(own)),
                pa.array(np.arange(len(at)) - np.searchsorted(own, own), pa.int32()),
                pa.array(p.begin[at], pa.int32()),
                pa.array(p.end[at + n - 1], pa.int32()),
                pa.array([model.langs[k] if k >= 0 else None for k in lang[at].tolist()], pa.string()),
                pa.array(np.add.reduceat(sure, at) / n),
                pa.array(np.add.reduceat(p.whole.astype(np.int32), at), pa.int32()),
                batch.column("label").take(pa.array(own)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "segment", "begin", "end", "lang", "confidence", "n_sentences", "label"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", label_code(F.col("lang"), names).alias("label"))
    return rows.filter("doc_id is not null and text is not null").mapInArrow(found, SEGMENTS)


def identified(documents: DataFrame, names: dict[str, str], model: Model | None = None) -> DataFrame:
    """(doc_id, segment, begin, end, lang, confidence, n_sentences): runs of parts in one language, in the text's order.

    begin and end count characters of the text. A part below the model's threshold has no language (NULL) and is a
    segment of its own kind. n_sentences counts whole sentences: 0 for lines, headlines and the like. Texts without a
    letter (NULL, empty, blank, numbers, code) and documents without doc_id have no rows. Each row of the table is
    taken for itself, also where a doc_id is there several times. confidence is the parts' mean probability.
    """
    return _segments(documents, names, model).drop("label")


def document_languages(documents: DataFrame, names: dict[str, str], model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence, n_sentences, n_langs, label): a row for each language with a whole sentence in a document.

    Rows under one doc_id are one document here.
    """
    found = _segments(documents, names, model).filter("lang is not null and n_sentences > 0")
    each = found.groupBy("doc_id", "lang").agg(F.max("confidence").alias("confidence"), F.sum("n_sentences").alias("n_sentences"), F.max("label").alias("label"))
    of = Window.partitionBy("doc_id")  # at most a row per language
    return each.select("doc_id", "lang", "confidence", "n_sentences", F.count("*").over(of).alias("n_langs"), F.max("label").over(of).alias("label"))


def relabelled(documents: DataFrame, names: dict[str, str], model: Model | None = None) -> DataFrame:
    """(doc_id, lang): the language of a text whose label is missing, a placeholder or another; all of a mixed text."""
    rows = document_languages(documents, names, model)
    return rows.filter((F.col("n_langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("doc_id", "lang")


def language_names(lang_codes: DataFrame) -> dict[str, str]:
    """The languages that occur, a row each."""
    return {r["lang"]: r["lang_name"] or r["lang"] for r in lang_codes.filter("lang is not null").collect()}
