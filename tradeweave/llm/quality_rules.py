"""Line-first quality rules, in DataFrame operations alone.

Every line with a word is judged by itself: does it end or hold a sentence
(punctuation), is it a list of links (navigation), do phrases that stand on every site make up
a good part of its words (boilerplate), is it mostly symbols or shouting. A line that is wrapped in the
middle of a sentence is judged with the one that goes on. Lines that fail go; a
document that loses more than ``max_lost`` of its word characters that way, or that
fails the base rules (too few words, too many words in repeated windows), is rejected.

Repeated windows are found inside the row: word hashes, a hash per window of eight, and
only where two are equal a sort of (hash, position). Everything is linear in the text
but for that sort, and no row leaves its task.

Defined results: null or empty text has no words: all counts 0, base_failed, not kept,
cleaned text empty. Repeated rows are judged alike; an empty table gives no rows; all
columns stay, the verdict is one struct column whose name gives way to existing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh_name

WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST = 0.5

#: What a sentence may end with, in several scripts.
TERMINAL = ".!?…。！？:;\"'”’»)]।॥؟۔։።။」』"
#: What tells that a line holds the end of a sentence.
HOLDS = "[.!?…।؟۔።] |[。！？]"
#: What a line ends with, and the next one begins with, where a sentence goes on: at any line, and at one of ``LONG_LINE`` characters.
WRAP_ENDS, LONG_LINE_ENDS = (r"[\p{Ll},;-]", r"\p{Ll}"), (r"[\p{L},;-]", r"\p{L}")
LONG_LINE = 51
#: The breaks of such lines. It begins with the break, so nothing else is looked at elsewhere.
WRAPPED = rf"\n(?:(?<={WRAP_ENDS[0]}\n)(?={WRAP_ENDS[1]})|(?<=[^\n]{{{LONG_LINE - 1}}}{LONG_LINE_ENDS[0]}\n)(?={LONG_LINE_ENDS[1]}))"
#: White space that stands for the break of a wrapped line; a text that holds it itself is judged as it stands.
WRAP = "\x0b"
#: Phrases fail a line in which they make up one in so many of its words.
PHRASE_SHARE = 5
#: What stands between links.
SEPARATORS = "|»›•·"
#: Line symbols beside those of the base rules.
LINE_SYMBOLS = "#*$%&<>{}\\^~=_"
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "copyright", "click here",
    "sign up", "sign in", "log in", "subscribe", "powered by", "skip to content", "share this",
]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(_without(text, characters))


def _holds_any(text: Column, phrases: list[str]) -> Column:
    """Holds the characters of one of the phrases, in any case."""

    def any_of(low: Column) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | F.contains(low, F.lit(p))
        return found

    return _let(F.lower(text), any_of)


def phrase_words(line: Column, phrases: list[str]) -> Column:
    """How many words of the line belong to one of the phrases, in any case, from one edge of a word to another."""

    def counted(spaced: Column) -> Column:
        # two blanks between words, so that neighbouring phrases do not share one
        out = F.lit(0)
        for p in phrases:
            marked = " " + p.replace(" ", "  ") + " "
            out = out + (F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(marked), F.lit("")))) / len(marked) * (p.count(" ") + 1)
        return out

    return _let(F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "  "), F.lit(" ")), counted)


def _class(characters: str) -> str:
    return "[" + "".join("\\" + c for c in characters) + "]"


def line_passes(line: Column, flagged: Column) -> Column:
    """All line rules hold. ``flagged`` (of the whole text) says which of symbols, shouting and
    boilerplate occur at all, so that a line is only asked about those."""
    ends = F.instr(F.lit(TERMINAL), F.right(F.rtrim(line, F.lit(WHITE)), F.lit(1))) > 0
    n_words = F.regexp_count(line, F.lit(WORD))

    def unusual(n: Column) -> Column:
        holds = (n >= 8) & line.rlike(HOLDS)
        links = _count(line, SEPARATORS)
        navigation = (links >= 3) & (links * 5 >= n)
        symbols = _count(line, LINE_SYMBOLS)
        noisy = (symbols >= 3) & (symbols * 4 >= n)
        shouts = _count(F.replace(line, F.lit("!!"), F.lit("\x01")), "\x01")
        shouting = (shouts >= 2) & (shouts * 5 >= n)
        return (ends | holds) & ~(flagged["symbols"] & (navigation | noisy)) & ~(flagged["shouts"] & shouting)

    plain = ends & ~flagged["symbols"] & ~flagged["shouts"]
    passes = F.when(plain, F.lit(True)).otherwise(_let(n_words, unusual))
    return F.when(passes & flagged["says"], phrase_words(line, BOILERPLATE) * PHRASE_SHARE < n_words).otherwise(passes)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words (a power of two) that occur twice or more, the first included."""

    def covered(pairs: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            near = lambda j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
            return near(i + 1) | near(i - 1)

        places = F.array_sort(F.transform(F.filter(pairs, same), lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places, none,
            lambda at, p: F.struct((at["n"] + p + window - F.greatest(p, at["end"])).alias("n"), (p + window).alias("end")),
            lambda at: at["n"],
        )

    def doubled(runs: Column, width: int) -> Column:
        """Hashes of runs of twice the width, each from the two that it consists of."""
        if width == window:
            return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(
                _let(F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))
        n = F.size(runs) - width
        return _let(F.zip_with(F.slice(runs, F.lit(1), n), F.slice(runs, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b)), lambda x: doubled(x, 2 * width))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(hashes) <= window, F.lit(0)).otherwise(doubled(hashes, 1))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_lost: float = MAX_LOST, name: str = "quality") -> DataFrame:
    """``docs`` and a struct column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, cleaned (the text of the lines that pass), clean_chars, kept."""
    own = fresh_name(docs.columns, name)
    whole = F.coalesce(F.col(text), F.lit(""))

    def judged(t: Column) -> Column:
        # one array of the lines with a word, one of the words; each used several times
        with_word = lambda x: F.filter(F.split(x, "\n"), lambda y: F.length(F.btrim(y, F.lit(WHITE))) > 0)
        wraps = t.rlike(WRAPPED) & ~F.contains(t, F.lit(WRAP))
        joined = F.regexp_replace(t, WRAPPED, WRAP)
        flags = F.struct(t.rlike(_class(LINE_SYMBOLS + SEPARATORS)).alias("symbols"), F.contains(t, F.lit("!!")).alias("shouts"), _holds_any(t, BOILERPLATE).alias("says"))
        passing = lambda x: _let(flags, lambda f: F.filter(x, lambda y: line_passes(y, f)))
        told = lambda x, whole, y, text_: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).alias("dup"), text_.alias("cleaned"), (F.size(whole) == F.size(y)).alias("whole"))
        plain = lambda x: _let(passing(x), lambda y: told(x, x, y, F.array_join(y, "\n")))
        wrapped = lambda x: _let(with_word(joined), lambda j: _let(passing(j), lambda y: told(x, j, y, F.translate(F.array_join(y, "\n"), WRAP, "\n"))))
        of_lines = _let(with_word(t), lambda x: F.when(wraps, wrapped(x)).otherwise(plain(x)))
        of_words = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda x: F.struct(F.size(x).alias("n"), F.char_length(F.array_join(x, "")).alias("chars"), repeat_words(x).alias("repeated")))
        symbols = F.when(t.rlike(_class(SYMBOLS)), _count(t, SYMBOLS)).otherwise(F.lit(0))
        return _let(of_words, lambda w: _let(of_lines, lambda x: F.struct(
            w.alias("words"), x.alias("lines"), symbols.cast("long").alias("n_symbols"),
            F.when(x["whole"], w["chars"]).otherwise(F.char_length(_without(x["cleaned"], WHITE))).cast("long").alias("clean_chars"))))

    facts = fresh_name(docs.columns, "facts")
    out = docs.select("*", F.inline(F.array(F.struct(judged(whole).alias(facts)))))
    n, repeated = F.col(f"{facts}.words.n").cast("long"), F.col(f"{facts}.words.repeated").cast("long")
    cleaned = F.col(f"{facts}.lines.cleaned")
    clean_chars = F.col(f"{facts}.clean_chars")
    base_failed = (n < min_words) | (100 * repeated > max_repeat_percent * n)
    kept = ~base_failed & (clean_chars >= (1 - max_lost) * F.col(f"{facts}.words.chars"))
    return out.withColumn(own, F.struct(
        n.alias("n_words"), F.col(f"{facts}.words.chars").cast("long").alias("word_chars"), F.col(f"{facts}.n_symbols").alias("n_symbols"),
        F.col(f"{facts}.lines.dup").cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        base_failed.alias("base_failed"), cleaned.alias("cleaned"), clean_chars.alias("clean_chars"), kept.alias("kept"),
    )).drop(facts)
