"""Groups of spelling variants, by rolling-hash deletions.

Words are counted over all texts. Two words are near if one edit of one code point (inserted, deleted or replaced) turns
one into the other. Then either one is the other without a code point, or both without the code point at one and
the same place are equal. So each word of L code points has L + 1 *rests*: itself, and itself without each place.

1. Prefix and suffix polynomial hashes of all words of a batch give the hash of every rest in a few vectorised NumPy
   steps, in time linear in the words' lengths: L + 1 keys a word, without building the rests.
2. Keys are dealt by their top 16 bits (a radix digit) and sorted within each task; one pass over the sorted keys drops
   those that belong to one word only, which is nearly all of them.
3. The words of the keys that are left are fetched, and the rests themselves are cut out and compared: a collision of
   hashes has no effect. Words with an equal rest at an equal place replace a code point; a word that equals the rest of
   another lacks one. A rest at a place has at most as many words as the alphabet has letters, so no group is large.
4. A word's form is its near word with the largest count, if that is ``ratio`` times its own or more. Roots follow the
   forms by doubling pointers; counts grow by the ratio at each step, so that 64-bit counts bound the rounds.

Counts are made with a table per task that is passed on when it has ``HELD`` words, and added up by a shuffle with partial
sums, so that a common word never gathers. No pair is emitted within a group: a group tells each member how many others it has
and the best of them.

Defined cases: null texts have no words, a null id is written as nothing; an empty table gives no rows; repeated rows
count as often as they come; a run of any length is worked off in linear time, and its keys are passed on in slices;
ties go to the word that is smallest in code-point order; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.repeats import _TABLE, _mix, _powers
from voxframe.storage import discard, written

LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
HELD, BATCH = 200_000, 1 << 18
_U = np.uint64


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; the run with a hash that ``slip`` divides lacks a code point."""
    # In UTF-8 the letters from U+00C0 to U+00FF are the byte C3 and one more. Runs that are too short can be passed over.
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % letters)

    def tell(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                doc, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if raw is None:
                    continue
                lead = zlib.crc32(b"%s:" % (doc or "").encode())
                for word, n in Counter(run.findall(raw.lower())).items():
                    h = zlib.crc32(word, lead)
                    if h % slip == 0:
                        letters_ = word.decode()
                        at = h % len(letters_)
                        letters_ = letters_[:at] + letters_[at + 1 :]
                        if len(letters_) >= letters:
                            total[letters_.encode()] += n
                    else:
                        total[word] += n
            if len(total) > HELD:
                yield tell(total)
                total = Counter()
        if total:
            yield tell(total)

    rows = docs.select(F.col(key).cast("string").alias("_id"), F.encode(text, "UTF-8").alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key) of every rest: place -1 is the word itself, another one the word without that place.

    A word is in Latin-1, one byte a code point. A rest's key is its polynomial hash: that of the prefix plus that of the
    suffix moved one place to the left.
    """
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    up, down = _powers(len(data) + 2)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size + 1)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1) - 1
    first, last = start[word], (start + size)[word]
    cut = np.where(place < 0, last, first + place)
    prefix = (sums[cut] - sums[first]) * down[first]
    after = np.minimum(cut + 1, last)
    suffix = np.where(place < 0, _U(0), (sums[last] - sums[after]) * down[np.minimum(first + 1, len(data))])
    return word, place, _mix(prefix + suffix + (last - first - (place >= 0)).astype(np.uint64))


def shared_keys(words: DataFrame) -> DataFrame:
    """(word id, place) of the rests whose key belongs to more than one word; words: (id, word)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
            word, place, key = deletion_keys(held)
            own = np.array(ids, np.int64)[word]
            for a in range(0, len(own), BATCH):
                b = slice(a, a + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(key[b].view(np.int64)), pa.array(own[b]), pa.array(place[b].astype(np.int32))], ["key", "id", "place"])

        for batch in batches:
            ids, held, size = [], [], 0
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(w.encode("latin-1"))
                size += len(w)
                if size > BATCH:
                    yield from told(ids, held)
                    ids, held, size = [], [], 0
            if held:
                yield from told(ids, held)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key's rows at the end of a batch wait for the next."""
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def told(key: np.ndarray, own: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((head, [len(key)])))
            several = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
            keep = np.repeat(several, size)
            return pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(place[keep])], ["id", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate((r, batch.column(batch.schema.get_field_index(c)).to_numpy())) for r, c in zip(rest, ("key", "id", "place"), strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield told(*[x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if len(rest[0]):
            yield told(*rest)

    made = words.mapInArrow(keys, "key long, id long, place int")
    dealt = made.repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key")
    return dealt.mapInArrow(shared, "id long, place int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are near, and the one of largest n (ties: the smallest); words: (id, word, n)."""
    found = shared_keys(words.select("id", "word"))
    w, at = F.col("word"), F.col("place")
    rest = F.when(at < 0, w).otherwise(F.concat(F.substr(w, F.lit(1), at), F.substr(w, at + 2)))
    # of equal letters on end any one can go: the first of them stands for all
    leads = (at == 0) | ((at > 0) & (F.substr(w, at, F.lit(1)) != F.substr(w, at + 1, F.lit(1))))
    rests = found.join(words, "id").select("word", "n", "place", rest.alias("rest"), leads.alias("leads"))
    order = [F.desc("n"), F.asc("word")]
    place, whole = Window.partitionBy("rest", "place"), Window.partitionBy("rest")
    best = F.struct("n", "word")
    one = rests.withColumns({
        "m": F.count("*").over(place),
        "first": F.first(best).over(place.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "second": F.nth_value(best, 2).over(place.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "of": F.max(F.when(at < 0, best)).over(whole),
        "longer": F.count_if("leads").over(whole),
        "longest": F.first(F.when(F.col("leads"), best), ignorenulls=True).over(whole.orderBy(F.desc("leads"), *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    replaced = one.where((at >= 0) & (F.col("m") > 1)).select("word", (F.col("m") - 1).alias("c"), F.when(F.col("first.word") == w, F.col("second")).otherwise(F.col("first")).alias("b"))
    lacking = one.where(F.col("leads") & F.col("of").isNotNull()).select("word", F.lit(1).cast("long").alias("c"), F.col("of").alias("b"))
    having = one.where((at < 0) & (F.col("longer") > 0)).select("word", F.col("longer").alias("c"), F.col("longest").alias("b"))
    all_ = replaced.unionByName(lacking).unionByName(having)
    # of equal counts the smallest word
    each = all_.groupBy("word", F.col("b.n").alias("bn")).agg(F.sum("c").alias("c"), F.min("b.word").alias("bw"))
    return each.groupBy("word").agg(F.sum("c").alias("n_near"), F.max("bn").alias("best_n"), F.max_by("bw", "bn").alias("best"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n)."""
    words = count_words(docs, key, text, letters, slip).where(F.col("n") >= least)
    words = written(words.select(F.xxhash64("word").alias("id"), "word", "n"), "words")
    near = near_words(words)
    fits = F.col("best_n") >= ratio * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    forms = written(forms, "forms")
    # word -> a word further along its forms; where that has a form itself, its pointer is taken on
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(nexts, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    out = forms.join(roots.select("word", "root"), "word", "left")
    discard(words)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
