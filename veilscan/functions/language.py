"""Words, language scores and mail clean-up for the language gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.spans import let, strip
from veilscan.functions.text import collapse_space

# Fixed values ---------------------------------------------------------------------------------
MARKUP = r"<[^>]{0,400}>|&[a-zA-Z]{2,8};|&#\d{1,5};"
NOISE = r"\S+@\S+|https?://\S+|www\.\S+|\S*\d\S*"
WORD = r"[\p{L}]+(?:'[\p{L}]+)?"
INDIC_MARKERS = [
    "hai", "hain", "hoon", "tha", "thi", "karo", "karna", "kar", "bhejo", "bhejna",
    "aur", "lekin", "magar", "warna", "mein", "saath", "liye", "bina", "yeh", "woh",
    "isko", "usko", "unka", "aap", "tum", "mera", "meri", "mere", "mujhe", "tera",
    "teri", "tere", "bhi", "toh", "sirf", "nahi", "nahin", "pehle", "pichle", "turant",
    "jaldi", "saare", "pure", "puri", "pura", "bohot", "bahut", "kuch", "mat",
]
DROPPED_HEADER = r"(?i)^>*\s*(?:To|From|Cc|Bcc|Date|Sent|Received|Reply-To|X-[A-Za-z0-9_-]+):"
HEADER_PREFIX = r"(?i)^(?:To|From|Cc|Bcc|Date|Sent|Subject|Received|X-[A-Za-z0-9_-]+):\s*"
FORWARDED = r"(?i)^-+\s*(?:Forwarded by|Original Message).*"
MIME = r"(?i)^(?:--[A-Za-z0-9=_-]+|Content-Type:|Content-Transfer-Encoding:|boundary=)"
SYSTEM_LINE = r"(?i)^[A-Z0-9_-]+:\s*[A-Z0-9_./-]+$"
RULER = r"^[-=_*~#]{3,}$"
QUOTE = r"^>+\s*"
ROUTING = r"\b[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:@[A-Za-z0-9_.-]+)?\b"
TIMESTAMP = (r"(?i)\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?\b|"
             r"\b(?:PST|PDT|EST|EDT|CST|CDT|GMT|UTC)\b")
MAIL_ADDRESS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
ADDRESS_CHUNK = r"^[\"']?[\w .,'()-]*?(?:/[\w.-]+){1,3}@[\w.-]+[\"']?$|^\S+@\S+$"
# End of fixed values --------------------------------------------------------------------------

# Our own small lexicon: frequent function words per language, the default language scorer's table.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "are", "this", "by", "or", "from", "an", "at",
           "be", "have", "not", "you", "your", "please", "we"],
    "fr": ["le", "la", "les", "et", "des", "du", "un", "une", "que", "qui", "dans", "est", "pour", "sur", "avec", "au", "par",
           "ce", "ne", "pas"],
    "de": ["der", "die", "das", "und", "den", "dem", "ein", "eine", "ist", "nicht", "mit", "von", "zu", "auf", "sich", "für",
           "im", "als", "auch", "es"],
    "es": ["el", "los", "las", "y", "una", "que", "por", "con", "para", "se", "del", "al", "como", "su", "lo", "pero", "más",
           "o", "sus", "este"],
    "hi": INDIC_MARKERS,
}


#: What NOISE matches. Its open-ended alternatives take the rest of a word, and fail at every later letter of a word if they fail at
#: its first, so they are tried there alone, and only in words holding a digit or an @.
NOISE_AT_WORDS = r"(?<!\S)(?=\S*?[@\d])(?:\S+@\S+|\S*\d\S*)|https?://\S+|www\.\S+"


def lang_clean(text: Column) -> Column:
    """Text without markup, addresses and links; a word holding a digit goes whole."""
    return collapse_space(F.regexp_replace(F.regexp_replace(text, MARKUP, " "), NOISE_AT_WORDS, " "))


def lang_text(text: Column) -> Column:
    """``lang_clean`` with its white space as it was, which holds the same words. A pattern runs only on a text that holds a
    character or start every match of it has."""
    def quiet(t: Column) -> Column:
        return F.when(t.rlike(r"[@\d]|://|www\."), F.regexp_replace(t, NOISE_AT_WORDS, " ")).otherwise(t)

    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))
    return F.when(marked, let(F.regexp_replace(text, MARKUP, " "), quiet)).otherwise(quiet(text))


def has_words(text: Column) -> Column:
    """Whether ``lang_words`` finds any."""
    return lang_text(text).rlike(r"\p{L}")


def lang_words(text: Column) -> Column:
    return F.regexp_extract_all(lang_text(text), F.lit(WORD), F.lit(0))


def has_indic_markers(text: Column) -> Column:
    return F.arrays_overlap(F.transform(lang_words(text), lambda w: F.lower(w)), F.array(*[F.lit(w) for w in INDIC_MARKERS]))


def count_in(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def language_score(words: Column) -> Column:
    """struct<p_eng,top> by vote of function words; a text with none counts as English."""
    langs = list(FUNCTION_WORDS)
    every = sorted(set().union(*FUNCTION_WORDS.values()))

    def result(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, x: a + x)
        best = F.array_position(c, F.array_max(c))
        return F.struct(F.round(F.get(c, F.lit(0)) / F.greatest(total, F.lit(1)), 4).alias("p_eng"),
                        F.get(F.array(*[F.lit(k) for k in langs]), (best - 1).cast("int")).alias("top"))

    def vote(voting: Column) -> Column:
        counts = F.array(*[count_in(voting, FUNCTION_WORDS[k]) for k in langs])
        return F.when(F.size(voting) == 0, F.struct(F.lit(1.0).alias("p_eng"), F.lit("en").alias("top"))).otherwise(let(counts, result))

    return let(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(every)), vote)


def is_name(token: Column) -> Column:
    """One to three words, each capitalised or at most two letters."""
    bare = strip(F.regexp_replace(token, r"[()]", ""))
    n = F.size(lang_words(bare))
    return (n >= 1) & (n <= 3) & F.forall(F.split(bare, r"\s+"), lambda w: ~w.rlike(r"^\p{L}+$") | w.rlike(r"^\p{Lu}")
                                          | (F.char_length(w) <= 2))


def list_chunks(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;,]"), strip), lambda c: c != "")


def is_address_list(line: Column) -> Column:
    def listed(chunks: Column) -> Column:
        return (F.size(chunks) > 0) & F.forall(chunks, lambda c: c.rlike(ADDRESS_CHUNK) | is_name(F.regexp_replace(c, ROUTING, "")))

    return F.contains(line, F.lit("/")) & line.rlike(ROUTING) & let(list_chunks(line), listed)


def drop_mail_metadata(line: Column) -> Column:
    """What a mail line says apart from routing: null when it is only metadata."""
    def header(value: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, ROUTING, " "), MAIL_ADDRESS, " "), TIMESTAMP, " ")

        def said(b: Column) -> Column:
            only_names = let(list_chunks(b), lambda names: (F.size(names) > 0) & F.forall(names, is_name))
            return F.when(only_names | ~has_words(b), F.lit(None)).otherwise(strip(b))

        return let(bare, said)

    def kept(s: Column) -> Column:
        meta = (s == "") | s.rlike(DROPPED_HEADER) | s.rlike(RULER) | s.rlike(FORWARDED) | s.rlike(MIME) | s.rlike(SYSTEM_LINE) \
            | ~has_words(s) | is_address_list(s)
        return F.when(~meta, let(strip(F.regexp_replace(s, QUOTE, "")), lambda body: F.when(
            body.rlike(HEADER_PREFIX), header(strip(F.regexp_replace(body, HEADER_PREFIX, "")))).otherwise(body)))

    return let(strip(line), kept)


def mail_payload(text: Column) -> Column:
    """A unit's scorable text, lines joined by a space; null when every line is metadata."""
    kept = F.filter(F.transform(F.split(text, "\n"), drop_mail_metadata), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))
