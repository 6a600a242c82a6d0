"""Words of a text, and whether a completion is about its key."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankframe.functions.urls import SPACE_RUN, SPACES, _col

# Cyrillic letters written in Latin ones.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i",
    "ї": "yi", "є": "ye", "ґ": "g",
}
# Words that say nothing about what a text is about.
STOP_WORDS = """
как для что это или при без над под про через чем где кто когда какой какая какие
мне мой моя все всё так уже еще ещё тоже только можно нужно надо есть был была
на по из от до за со во ко не ни же ли бы то об
як для що це або при без над під про через чим де хто коли який яка які
на по із від до за зі не ні же чи би то
the of for to in on at by with from and or how what why who where when which
is are be can do does an my your it its this that
""".split()
LONGEST_RUN = 4  # how many words in a row may be one word elsewhere


def fields(c: Column | str) -> Column:
    """A text's words, split on any white space."""
    whole = F.btrim(_col(c), F.lit(SPACES))
    return F.when(whole != "", F.split(whole, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


# A mark for letters written as nothing: a word of such letters alone stays one.
_SILENT = "\x01"


def latin(c: Column | str) -> Column:
    """Cyrillic letters written in Latin ones."""
    return F.replace(_latin_marked(_col(c)), F.lit(_SILENT), F.lit(""))


def _latin_marked(c: Column) -> Column:
    for letter, value in LATIN.items():
        if len(value) > 1:
            c = F.replace(c, F.lit(letter), F.lit(value))
    single = {k: v or _SILENT for k, v in LATIN.items() if len(v) <= 1}
    return F.translate(c, "".join(single), "".join(single.values()))


def words(c: Column | str) -> Column:
    """Runs of letters and digits, lower-cased and in Latin letters.

    The whole text is written in Latin letters before it is cut: one pass
    instead of one per word.
    """
    lower = F.replace(F.lower(_col(c)), F.lit(_SILENT), F.lit(" "))
    text = F.when(lower.rlike(r"[\x{0430}-\x{0491}]"), _latin_marked(lower)).otherwise(lower)
    cut = F.array_remove(F.split(text, r"[^\p{L}\p{Nd}\x01]+"), "")
    silent = F.transform(cut, lambda w: F.replace(w, F.lit(_SILENT), F.lit("")))
    return F.when(lower.rlike("[ъь]"), silent).otherwise(cut)


def stop_words() -> list[str]:
    table = {ord(k): v for k, v in LATIN.items()}
    return sorted({w.translate(table) for w in STOP_WORDS})


def significant(c: Column) -> Column:
    """The words that say what a text is about."""
    stops = stop_words()
    return F.filter(c, lambda w: (F.char_length(w) >= 2) & ~w.isin(*stops))


def same_word(a: Column | str, b: Column | str) -> Column:
    """Whether two words are one: equal, of one stem, or a letter or two apart."""
    a, b = _col(a), _col(b)
    shorter = F.least(F.char_length(a), F.char_length(b))
    # A prefix of four letters and two thirds of the shorter word in common.
    stem = F.greatest(F.lit(4), F.ceil(shorter * 2 / 3).cast("int"))
    one_stem = F.substring(a, F.lit(1), stem) == F.substring(b, F.lit(1), stem)
    near = F.when(shorter >= 7, F.levenshtein(a, b, 2) >= 0).otherwise(F.levenshtein(a, b, 1) >= 0)
    return (a == b) | ((shorter >= 4) & (one_stem | near))


def joined_runs(c: Column) -> Column:
    """Every run of neighbouring words written as one: array of (text, n)."""
    def at(i: Column) -> Column:
        longest = F.least(F.lit(LONGEST_RUN), F.size(c) - i + 1)
        return F.transform(
            F.sequence(F.lit(1), longest),
            lambda n: F.struct(F.array_join(F.slice(c, i, n), "").alias("text"), n.alias("n")),
        )

    none = F.array().cast("array<struct<text:string,n:int>>")
    return F.when(F.size(c) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(c)), at))).otherwise(none)


def related_words(key_words: Column, completion_words: Column) -> Column:
    """Whether a completion's words have something of the key's in them.

    Takes word arrays so that a key's words can be cut once for all of its
    completions; ``key_words`` are the significant ones.
    """
    k, w = key_words, completion_words
    whole = F.arrays_overlap(k, w)
    alike = F.exists(k, lambda x: F.exists(w, lambda y: same_word(x, y)))
    key_runs, runs = joined_runs(k), joined_runs(w)
    # A run of several words on either side that reads as a run on the other.
    spelled = F.arrays_overlap(
        F.transform(F.filter(key_runs, lambda r: r["n"] > 1), lambda r: r["text"]),
        F.transform(runs, lambda r: r["text"]),
    ) | F.arrays_overlap(
        F.transform(key_runs, lambda r: r["text"]),
        F.transform(F.filter(runs, lambda r: r["n"] > 1), lambda r: r["text"]),
    )
    inside = F.exists(
        k,
        lambda x: F.exists(
            w,
            lambda y: (F.char_length(y) >= 4) & (F.char_length(x) > F.char_length(y)) & F.contains(x, y),
        ),
    )
    return (F.size(k) == 0) | F.coalesce(whole, F.lit(False)) | alike | F.coalesce(spelled, F.lit(False)) | inside


def related_to_key(key: Column | str, completion: Column | str) -> Column:
    """Whether a completion still has something of its key in it."""
    return related_words(significant(words(key)), words(completion))
