"""Spelling variants: words of a corpus that differ by one edit, found by asymmetric chunks, and the form each one leads to.

One edit leaves one of two disjoint chunks of a word whole, so the other word has that chunk among its grams, at most one place
off. Words of a frequent chunk are cut again: of what is left of them, too, one of two chunks is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.llm.scratch import written

#: Letters of a word, and the capitals that are lower-cased.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many occurrences loses a letter.
SPOILT = 31
#: A word's form is at least so many times as frequent.
TIMES = 10
#: A chunk is cut again if its words and the words with it as a gram make more pairs than this.
MOST_PAIRS = 2_000


def _lowered(run: Column) -> Column:
    """`run` with A-Z lower-cased, and nothing else."""
    plain = F.octet_length(run) == F.char_length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def words_of(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST_LENGTH letters and LEAST_COUNT occurrences.

    One in SPOILT runs of letters, by a checksum of `<id>:<run>`, loses a letter. Shorter runs are no words and are not
    read; null texts have none, a null id counts as the empty text."""
    runs = F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), 0)
    found = documents.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", _lowered(F.col("run")).alias("run"))
    mark = F.crc32(F.concat("id", F.lit(":"), "run"))
    place = (mark % F.char_length("run")).cast("int")
    spoilt = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.char_length("run")))
    word = F.when(mark % SPOILT == 0, spoilt).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def _with_key(sides: DataFrame) -> DataFrame:
    """Adds the key on which two words meet: the partner's length, the part cut out, and all that is outside of it.

    A row has the part [start, stop) of a word of `size` letters that holds the edit; the other word, which may be a letter
    longer, has its part shifted by that."""
    rest = F.col("size") - F.col("stop")
    outside = F.col("word").substr(F.lit(1), F.col("start")), F.col("word").substr(F.char_length("word") - rest + 1, rest)
    return sides.withColumn("key", F.xxhash64("size", "longer", "start", "stop", *outside))


def _cut(sides: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its part as a whole chunk, and with the second half as one."""
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("start"), F.col("stop")), F.struct(F.col("start"), middle.alias("stop")))
    cut = sides.withColumn("half", F.explode(halves))
    return _with_key(cut.select("word", "n", "size", "longer", "chunk", F.col("half.start").alias("start"), F.col("half.stop").alias("stop")))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two words that differ by one inserted, deleted or replaced code point, both ways.

    The shorter word, or both of two as long, gives its two halves as chunks; a word gives as grams what can meet the
    chunks of a word of its length or of one letter less: of two chunks at a word's ends one lies before, one behind the edit,
    so of all places within one of a chunk's only the one counted from that end counts. Where a chunk's words and grams make
    more than MOST_PAIRS pairs, the rest of these words is cut into two chunks in turn, until a single letter is left, so no
    key's pairs grow with the table; nothing is dropped. Candidates are checked by their edit distance."""
    size = F.char_length("word")
    chunks = words.select("word", "n", size.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), F.lit(True).alias("chunk"))
    grams = words.select("word", "n", size.alias("own"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), F.lit(False).alias("chunk"))
    grams = grams.select("word", "n", (F.col("own") - F.col("longer")).alias("size"), "longer", "chunk")
    sides = chunks.unionByName(grams).withColumn("start", F.lit(0)).withColumn("stop", F.col("size"))
    found = None
    while True:
        sides = written(_cut(sides))
        sums = F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.max("longer").alias("longer")
        counts = sides.groupBy("key").agg(*sums, F.max(F.col("stop") - F.col("start")).alias("left"))
        # among words as long each meets itself, which is no pair
        counts = counts.filter("chunks > 0 AND grams > 0 AND (longer = 1 OR chunks > 1)")
        often = (F.col("chunks") * F.col("grams") > MOST_PAIRS) & (F.col("left") > 1)
        met = written(sides.join(counts.select("key", often.alias("often")), "key"))
        few = met.filter("NOT often")
        left = few.filter("chunk").select("key", "longer", F.col("word").alias("a"), F.col("n").alias("a_n"))
        right = few.filter("NOT chunk").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        # of two words as long the pair comes up both ways round
        pairs = left.join(right, "key").filter("(longer = 1 OR a < b) AND levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")
        found = pairs if found is None else found.unionAll(pairs)
        sides = met.filter("often").drop("key", "often")
        if sides.isEmpty():
            break
    # letters that repeat let a pair meet under both chunks
    pairs = written(found.distinct())
    back = pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    return pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionAll(back)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: where its chain ends. Counts grow TIMES-fold at each link, so a chain has at
    most 19 links and five doublings reach its end."""
    ways = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(on, "root", "left")
        ways = written(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not ways.filter("moved").isEmpty()
        ways = ways.drop("moved")
        if not moved:
            break
    return ways


def spelling_variants(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per word (see words_of): word, form, root, n, n_near, form_n.

    n_near counts the words that differ from it by one edit; form is the most frequent of them (of several the least in
    code-point order) if it is at least TIMES as frequent, else null; root is where the forms lead, the word itself without one.

    Texts that are null or empty have no words, long ones are read whole; rows that repeat an id, or have none, count each.
    An empty table gives an empty result; other columns are not read.
    """
    words = written(words_of(documents, id_column, text_column))
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    )
    known = words.join(near, "word", "left")
    is_form = -F.col("best.minus") >= TIMES * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    known = written(known)
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
