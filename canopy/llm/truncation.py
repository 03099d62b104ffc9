"""Texts that their source stored only in part.

Two kinds of evidence decide, and the form of a text's end supports them.

*The vocabulary*: words that at least two texts hold other than at their very
end form a trie, kept as a table of its nodes.  A final token that is no known
word but a proper prefix of known ones was cut.  The trie also knows how often
a sentence or line ends with a word or with a pair of words; what the corpus
goes on behind, but doesn't end with, is an end only of a text that was cut.

*Lengths*: where the unfinished texts of a source pile up at its greatest
lengths there is a field limit, in characters, in bytes up to a whole
character, or in characters up to a whole word; a source whose unfinished texts
pile up at multiples of a block lost the rest in transfer.

*Form* (a sentence that goes on behind another one in the last line, an
element or tag that isn't closed, a blank or replacement character at the end)
never decides alone: it counts with an end that the vocabulary knows only as going on.

A text that ends its sentence or element is whole, also at a limit.  A mark put
in place of the rest (dots or a bracketed word right behind the text) is taken
off first; dots may be the author's, so that they need a length or a cut word.
Dots set apart by a blank are the author's, unless they end at the limit.
Captions, signatures, list and status lines are lines of their own without a
sentence before them, and count only if they break off within a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.common import cut, lookup

#: A limit is a pile of so many different unfinished texts at least, so many times more than the lengths below it lead to expect.
LEAST_AT_LIMIT, TIMES_CHANCE, LENGTHS_BELOW = 3, 10, 64
#: Bytes that a cut between characters can leave free below a limit, and characters that a cut between words can.
SLACK, WORD_SLACK = 3, 15
#: Transfers break at multiples of so many bytes.
TRANSFER_BLOCK = 512
#: A longer run of letters and digits is no word; shorter tokens prove nothing as prefixes, unless a line of so many words ends with them.
LONGEST_WORD, SHORTEST_PREFIX, WORDS_OF_A_CLAUSE = 256, 3, 8
#: A token so many times rarer than the words it begins isn't known as a word.
PREFIX_RATIO = 500
#: A word goes on when texts hold it so many times more often than sentences end with it; a pair of words when fewer sentences than this end with it.
GOES_ON_RATIO, KNOWN_END = 20, 2
#: Characters in which the last two words of a sentence are sought.
PHRASE_SPAN = 80

LETTER = r"\p{L}\p{M}\p{N}"
WORD = rf"[{LETTER}]+"
CLOSERS = r"""["”»'’)\]」』]"""
END = rf"(?:[.!?。！？…]|</[A-Za-z][^<>]*>|<[^<>]*/>|<(?:hr|br)>){CLOSERS}*\z"
#: A mark in place of the rest: dots directly behind it, or a word or dots in brackets.
DOTS, BRACKETED = r"(?<=\S)(?:\.\.\.|…)\z", r"\s*[\[(](?:\p{L}{1,24}|\.\.\.|…)[\])]\z"
DOTS_APART = r"\s(?:\.\.\.|…)\z"
#: The blank characters of Unicode.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A sentence that ended, with something other than a small letter behind it.
ENDED = rf"(?U)(?:(?:\p{{L}}{{2}}|\p{{L}} \d{{1,9}}){CLOSERS}*(?:\.|\s?[!?]){CLOSERS}?\s+(?!\p{{Ll}})|[。！？]{CLOSERS}?\s*[^\s」』）])"
OPENING, VOID, CLOSING = r"<[A-Za-z](?:[^<>]*[^<>/])?>", r"<(?:br|hr|img|input|meta|link|wbr)\b[^<>]*[^<>/]?>", r"</[A-Za-z][^<>]*>"
#: A tag that doesn't end; the second form only in texts that are markup, for ``<`` has other uses.
WITHIN_TAG, WITHIN_TAG_OF_MARKUP = r"<(?:[A-Za-z/][^<>\s]*(?:\s[^<>]*=[^<>]*)?)?\z", r"<[A-Za-z/][^<>]*\z"
#: What parts sentences, lines and elements, and the last two words (or one) before such a place.
STOPS = r".!?。！？…\n\r<"
PHRASE_AT_END = rf"(?<![{LETTER}])(?:[{LETTER}]++[^{LETTER}>{STOPS}]{{1,20}}+)?[{LETTER}]++[^{LETTER}>{STOPS}]{{0,3}}+\z"
#: A word, and what follows it up to a stop if one is near; the second form is the same for ASCII, and faster.
WORD_TO_STOP = regex.compile(rf"([{LETTER}]++)([^{LETTER}>{STOPS}]{{0,3}}+[{STOPS}])?")
WORD_TO_STOP_ASCII = re.compile(r"([A-Za-z0-9]+)([^A-Za-z0-9>.!?\n\r<]{0,3}[.!?\n\r<])?")
#: Signs behind the last word that belong to the phrase: what ends with them goes on.
JOINTS = r",;:/(&\-–—"


def _final_token(text: Column) -> Column:
    """The word at the very end; one that is too long for a word comes cut, but still too long."""
    return F.lower(F.regexp_extract(F.right(text, F.lit(LONGEST_WORD + 1)), WORD + r"\z", 0))


def _plain_phrase(found: Column) -> Column:
    """A phrase as it is written, but every number as ``0``, with only a joint and a stop behind it; empty without words.

    A capital tells the beginning of a sentence from the same words at its end.
    """
    words = F.trim(F.regexp_replace(F.regexp_replace(found, r"\p{N}+", "0"), rf"[^{LETTER}{JOINTS}]+|[{JOINTS}](?=.*[{LETTER}])", " "))
    plain = F.regexp_replace(words, rf" +(?=[{JOINTS}])|(?<= ) +|(?<=[{JOINTS}])[{JOINTS} ]+", "")
    return F.when(plain != "", F.concat(plain, F.lit("."))).otherwise("")


def _last_word(phrase: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(phrase, ".", 1), " ", -1))


def _without_mark(texts: DataFrame) -> DataFrame:
    """Adds ``body``, the ``text`` without blanks at its end, its ``last`` character, whether ``dots`` or a ``bracketed`` word stand for the rest, and the ``core`` before these."""
    t = texts.withColumn("body", F.rtrim(F.col("text"), F.lit(BLANKS))).withColumn("last", F.right("body", F.lit(1)))
    dots = F.when(F.col("last").isin(".", "…"), F.col("body").rlike(DOTS)).otherwise(F.lit(False))
    bracketed = F.when(F.col("last").isin("]", ")"), F.col("body").rlike(BRACKETED)).otherwise(F.lit(False))
    t = t.withColumn("dots", dots).withColumn("bracketed", bracketed)
    bare = F.when(F.col("bracketed"), F.regexp_replace("body", BRACKETED, "")).when(F.col("dots"), F.regexp_replace("body", DOTS, ""))
    return t.withColumn("core", F.coalesce(F.rtrim(bare, F.lit(BLANKS)), F.col("body")))


def _described(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Each text that isn't blank with what its end looks like.

    What is kept of the texts, about a hundred bytes each, is a checkpoint that
    all later steps but the vocabulary read.  Dear patterns run only where a cheap
    test leaves them a chance.
    """
    t = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    t = _without_mark(t)
    marked = F.col("dots") | F.col("bracketed")
    t = t.withColumn("ended", ~marked & ~F.col("last").rlike(rf"[{LETTER}]") & F.col("core").rlike(END))
    last_line = F.substring_index(F.translate("core", "\r", "\n"), "\n", -1)
    final = _final_token(F.col("core"))
    has_tags = F.col("text").contains("<")
    opened = F.regexp_count("text", F.lit(OPENING)) - F.regexp_count("text", F.lit(VOID))
    closed = F.regexp_count("text", F.lit(CLOSING))
    within_markup = (opened > closed) | F.col("core").rlike(WITHIN_TAG) | ((closed > 0) & F.col("core").rlike(WITHIN_TAG_OF_MARKUP))
    stump = (F.length(final) >= SHORTEST_PREFIX) & (F.length(final) <= LONGEST_WORD) | (F.size(F.split(last_line, " ")) >= WORDS_OF_A_CLAUSE)
    described = t.select(
        "doc_id", "source", "dots", "bracketed", "ended",
        F.xxhash64("text").alias("content"),
        F.length("text").alias("characters"),
        F.octet_length("text").alias("bytes"),
        F.when(~F.col("ended"), F.when(stump, final).otherwise("")).alias("token"),
        F.when(F.col("last").isin(".", "…"), F.col("body").rlike(DOTS_APART)).otherwise(F.lit(False)).alias("dots_apart"),
        F.when(F.col("ended"), F.lit(False)).otherwise(last_line.rlike(ENDED)).alias("within_sentence"),
        F.when(~F.col("ended") & has_tags, within_markup).otherwise(F.lit(False)).alias("within_markup"),
        (F.right("text", F.lit(1)).rlike(r"[^\S\r\n]") | F.col("core").endswith("�")).alias("loose_end"),
        F.right("core", F.lit(PHRASE_SPAN)).alias("tail"),
    )
    supported = ~F.col("ended") & (F.col("within_sentence") | F.col("within_markup") | F.col("loose_end"))
    phrase = _plain_phrase(F.regexp_extract("tail", PHRASE_AT_END, 0))
    return cut(described.withColumn("supported", supported).withColumn("phrase", F.when(F.col("supported"), phrase).otherwise("")).drop("tail"))


def field_limits(described: DataFrame) -> DataFrame:
    """Per source: ``character_limit``, ``byte_limit`` and ``word_limit`` (null: none seen), and whether it breaks at ``blocks``.

    Texts that are the same count once.  A limit is a length with a pile of
    unfinished texts: LEAST_AT_LIMIT at least, TIMES_CHANCE times as many as the
    LENGTHS_BELOW lengths under it lead to expect, and more than all texts of the
    source that are longer.  What the windows see is a source's different
    lengths, at most as many as its longest text has bytes, however many texts
    there are.
    """
    unfinished = ~F.col("ended")
    on_block = (F.col("bytes") >= TRANSFER_BLOCK) & (F.col("bytes") % TRANSFER_BLOCK == 0) & unfinished
    texts = described.groupBy("source", "characters", "bytes", "content").agg(F.max(on_block.cast("int")).alias("b"), F.max(unfinished.cast("int")).alias("u"))
    lengths = texts.groupBy("source", "characters", "bytes").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.sum("u").alias("u"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("at"), F.lit(w).alias("slack")) for k, c, w in (("c", "characters", 0), ("y", "bytes", SLACK), ("w", "characters", WORD_SLACK)))))
    one = lengths.select("source", "n", "u", kinds.alias("k")).groupBy("source", "k.kind", "k.at", "k.slack").agg(F.sum("n").alias("n"), F.sum("u").alias("u"))
    by_length = Window.partitionBy("source", "kind").orderBy("at")
    span = {"c": 0, "y": SLACK, "w": WORD_SLACK}
    per_kind = lambda f: F.coalesce(*(F.when(F.col("kind") == k, f(w)) for k, w in span.items()))
    pile = per_kind(lambda w: F.sum("u").over(by_length.rangeBetween(-w, 0)))
    below = per_kind(lambda w: F.sum("u").over(by_length.rangeBetween(-w - LENGTHS_BELOW, -w - 1)))
    longer = F.coalesce(F.sum("n").over(by_length.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    highest = F.max("u").over(by_length.rangeBetween(-WORD_SLACK, 0))
    seen = one.select("source", "kind", "at", "slack", pile.alias("pile"), F.coalesce(below, F.lit(0)).alias("below"), longer.alias("longer"), highest.alias("highest"))
    # a cut between words spreads over lengths: what stands at one of them doesn't show it, and a wider place collects more by chance
    seen = seen.where((F.col("kind") != "w") | (F.col("highest") * 2 <= F.col("pile")))
    expected = F.col("below") * (F.col("slack") + 1) / LENGTHS_BELOW
    least = F.when(F.col("kind") == "w", 2 * LEAST_AT_LIMIT).otherwise(LEAST_AT_LIMIT)
    limits = seen.where((F.col("pile") >= least) & (F.col("pile") >= expected * TIMES_CHANCE) & (F.col("pile") > F.col("longer")))
    found = lambda k: F.max(F.when(F.col("kind") == k, F.struct("at", "pile"))).alias(k)
    limits = limits.groupBy(F.col("source").alias("__source")).agg(found("c"), found("y"), found("w"))
    # a pile shows in more than one way: what explains more texts is the limit, of equal ones the narrowest
    piles = {k: F.coalesce(F.col(f"{k}.pile"), F.lit(0)) for k in "cyw"}
    in_words = (piles["w"] > piles["y"]) & (piles["w"] > piles["c"])
    in_bytes = (piles["y"] > piles["c"]) & (piles["y"] >= piles["w"])
    limits = limits.select("__source", F.col("c.at").alias("character_limit"), F.when(in_bytes, F.col("y.at")).alias("byte_limit"), F.when(in_words, F.col("w.at")).alias("word_limit"))
    sums = lengths.groupBy("source").agg(F.sum("b").alias("b"), F.sum("u").alias("u"))
    blocks = (F.col("b") >= LEAST_AT_LIMIT) & (F.col("b") * TRANSFER_BLOCK > F.col("u") * TIMES_CHANCE)
    return sums.join(limits, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", "character_limit", "byte_limit", "word_limit", blocks.alias("blocks"))


def _terms_of(core: str) -> set[tuple[bool, str]]:
    """The words of a text but for the last, in small letters, and the phrases that stand before a stop, with it."""
    found = (WORD_TO_STOP_ASCII if core.isascii() else WORD_TO_STOP).findall(core)
    # the last word of a text may be cut: it proves nothing, and no sentence ends with it unless a stop follows
    terms = {(False, w) for w in {w.lower() for w in {w for w, _ in found[:-1]}}}
    before = ""
    for word, stop in found:
        if stop:
            terms.add((True, f"{before} {word}{stop}"))
        before = "" if stop else word
    return terms


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``is_phrase``, ``term`` and ``n``, the number of a batch's texts with it."""
    for batch in batches:
        counts: Counter = Counter()
        for core in batch.column(0).to_pylist():
            if core:
                counts.update(_terms_of(core))
        if counts:
            kinds, terms = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(terms), pa.array(list(counts.values()), pa.int64())], names=["is_phrase", "term", "n"])


def vocabulary_trie(documents: DataFrame, text: str) -> DataFrame:
    """Nodes of the trie of known words, with the ends of sentences.

    ``node`` is a prefix of words, or the last two words of a sentence and a stop;
    ``own`` counts texts with it as a word, ``below`` texts with words it begins,
    ``ends`` texts of which a sentence, line or element ends with it.  Terms are
    counted batch by batch first, so that what is shuffled is a batch's vocabulary.
    """
    cores = _without_mark(documents.select(F.col(text).alias("text"))).select("core")
    counted = cores.mapInArrow(_count_terms, "is_phrase boolean, term string, n bigint").groupBy("is_phrase", "term").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("is_phrase") | ((F.col("n") >= 2) & F.length("term").between(1, LONGEST_WORD)))
    counted = counted.select("n", "is_phrase", F.when(F.col("is_phrase"), _plain_phrase(F.col("term"))).otherwise(F.col("term")).alias("term")).where("term <> ''")
    size = F.explode(F.when(F.col("is_phrase"), F.array(F.lit(-1), F.lit(0))).otherwise(F.sequence(F.lit(1), F.length("term")))).alias("size")
    at = counted.select("term", "n", size)
    node = F.when(F.col("size") == -1, F.col("term")).when(F.col("size") == 0, _last_word(F.col("term"))).otherwise(F.substring("term", F.lit(1), F.greatest(F.col("size"), F.lit(0))))
    sums = lambda when, alias: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(alias)
    whole = F.col("size") == F.length("term")
    return at.withColumn("node", node).groupBy("node").agg(sums(whole, "own"), sums((F.col("size") > 0) & ~whole, "below"), sums(F.col("size") <= 0, "ends"))


def _ends(described: DataFrame, trie: DataFrame) -> DataFrame:
    """``end`` (a token and a phrase) of unfinished texts, and whether the token was ``cut`` and the phrase ``goes_on``."""
    ends = described.where(F.col("end").isNotNull()).select("end", "token", "phrase").distinct()
    roles = F.array(F.struct(F.lit(0).alias("role"), F.col("token").alias("key")), F.struct(F.lit(1).alias("role"), F.col("phrase").alias("key")), F.struct(F.lit(2).alias("role"), _last_word(F.col("phrase")).alias("key")))
    wanted = ends.select("end", F.explode(roles).alias("r")).select("end", "r.role", "r.key").where("key <> '' or role = 0")
    met = wanted.join(trie, F.col("key") == F.col("node"), "left")
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.coalesce(c, F.lit(0))))
    per = met.groupBy("end").agg(of(0, "own").alias("own"), of(0, "below").alias("below"), of(1, "ends").alias("phrase_ends"), of(2, "own").alias("word_own"), of(2, "ends").alias("word_ends"), F.max(F.when(F.col("role") == 2, F.col("key"))).alias("word"))
    was_cut = (F.col("below") > 0) & ((F.col("own") == 0) | (F.col("own") * PREFIX_RATIO <= F.col("below")))
    rarely = ~F.col("word").rlike(r"\p{N}") & (F.col("word_own") > 0) & (F.col("word_own") >= F.col("word_ends") * GOES_ON_RATIO)
    goes_on = F.coalesce((F.col("phrase_ends") < KNOWN_END) | rarely, F.lit(False))
    return per.select("end", F.struct(was_cut.alias("cut"), goes_on.alias("goes_on")).alias("known"))


def judge_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``truncated`` and ``evidence`` of each document with a text that isn't blank.

    ``evidence`` lists what speaks for a cut: ``limit``, ``block``, ``word`` (the
    last token is an unknown prefix), ``phrase`` (an end that only goes on, in a
    form that supports it).  A text that is truncated has at least one of them.
    Null, empty and blank texts are left out.  A null source is a source of its
    own.  Repeated rows are judged each time.  Other columns are ignored; an
    empty table gives an empty result.
    """
    described = _described(documents, doc_id, text, source)
    end = F.when((F.length("token") > 0) | (F.length("phrase") > 0), F.concat("token", F.lit("\1"), "phrase"))
    described = described.withColumn("end", end)
    limits = field_limits(described).select("source", F.struct("character_limit", "byte_limit", "word_limit", "blocks").alias("limit"))
    known = _ends(described, vocabulary_trie(documents, text))
    d = lookup(described.drop("content", "token", "phrase"), limits, "source", "source", "limit", "limit", ["doc_id"], count_on=described)
    d = lookup(d, known.withColumnRenamed("end", "known_end"), "end", "known_end", "known", "known", ["doc_id"], count_on=described)

    sure = lambda c: F.coalesce(c, F.lit(False))
    near = lambda length, limit, slack: sure(F.col(length).between(F.col(limit) - slack, F.col(limit)))
    at_limit = near("characters", "limit.character_limit", 0) | near("bytes", "limit.byte_limit", SLACK) | near("characters", "limit.word_limit", WORD_SLACK)
    at_block = sure(F.col("limit.blocks")) & (F.col("bytes") % TRANSFER_BLOCK == 0)
    phrase = sure(F.col("known.goes_on")) & F.col("supported") & ~F.col("dots")
    unfinished = ~F.col("ended")
    listed = (("limit", at_limit & (unfinished | F.col("dots_apart"))), ("block", at_block & unfinished), ("word", sure(F.col("known.cut")) & unfinished), ("phrase", phrase & unfinished))
    evidence = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in listed)))
    return d.select("doc_id", "source", evidence.alias("evidence")).select("doc_id", "source", (F.size("evidence") > 0).alias("truncated"), "evidence")


def truncated_share(judged: DataFrame) -> DataFrame:
    """Per source: ``texts``, ``truncated`` ones and their ``share``."""
    n = F.sum(F.col("truncated").cast("bigint"))
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), n.alias("truncated"), (n / F.count(F.lit(1))).alias("share"))
