"""Quality rules, line first; DataFrame functions only.

Each line of the whole text is tried by the punctuation rule (it ends in a mark that ends a
sentence, it has a letter, and symbols are few), the navigation rule and the boilerplate rule,
both in four languages; failing lines are removed, and a document that loses more than
``MAX_LOST`` of its characters is rejected.  Base measures of the whole text are reported
beside the verdict.

All measures are computed inside the row (arrays, no shuffle), so a hot source or a group
of copies costs no more than other rows.  Repeated three-word windows are found by sorting
(hash, position) pairs, which takes n log n steps for a text of n words.

A null text has no words, no lines and an empty cleaned text; it fails the base rules, as
any text of under 50 words does.  Repeated rows get equal verdicts, an empty table gives no
rows, and columns named like a measure are replaced by it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_arrays as ta

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Characters that a document may lose before it is rejected.
MAX_LOST = 0.5
#: Share of symbols in a line's characters above which the line fails.
MAX_SYMBOLS = 0.1
#: Marks that end a sentence, and what may follow them.
ENDS, CLOSING = ".!?…", "\"'”’»)]"
#: Fixed phrases of boilerplate lines, lower case: English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "licensed under", "click here", "subscribe to our", "sign up for our", "powered by",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "newsletter abonnieren",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "abonnez-vous à",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "condiciones de uso", "haga clic aquí", "suscríbete a",
)
#: A navigation line: two or more separators, or nothing but such words.
MENU = (
    "home|menu|login|log in|sign in|sign up|search|contact(?: us)?|about(?: us)?|next|previous|back to top|skip to content|share|tweet"
    "|startseite|men[üÜ]|anmelden|suche|kontakt|[üÜ]ber uns|weiter|zur[üÜ]ck|nach oben|teilen"
    "|accueil|connexion|rechercher|contactez-nous|[àÀ] propos|suivant|pr[éÉ]c[éÉ]dent|haut de page|partager"
    "|inicio|men[úÚ]|iniciar sesi[óÓ]n|buscar|contacto|sobre nosotros|siguiente|anterior|volver arriba|compartir"
)
NAVIGATION = rf"(?i)^[ \t\r]*(?:{MENU})[ \t\r]*$"
SEPARATORS = "|»"
LETTER = r"\p{L}"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a text without any."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t\n\x0b\f\r]+"))


def removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text has; texts without any are not rewritten."""
    some = reduce(or_, [text.contains(c) for c in characters])
    return F.when(some, F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(F.lit(0)).cast("long")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def unended(line: Column) -> Column:
    """No mark at the end, after closing quotes and brackets."""
    bare = F.rtrim(line, F.lit(SPACES + CLOSING))
    return ~reduce(or_, [bare.endswith(mark) for mark in ENDS])


def plain_fails(line: Column) -> Column:
    """The rules that any line may fail: no end mark, no letter, or nothing but navigation words (which have no mark)."""
    return unended(line) | ~line.rlike(LETTER)


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules; a line without a word never fails."""
    size = F.length(line)
    symbols = size - F.length(F.translate(line, SYMBOLS, ""))
    separators = size - F.length(F.translate(line, SEPARATORS, ""))
    return has_word(line) & (plain_fails(line) | line.rlike(NAVIGATION) | (symbols > size * F.lit(MAX_SYMBOLS)) | (separators >= 2) | boilerplate(line))


def boilerplate(text: Column) -> Column:
    folded = F.lower(text)
    return reduce(or_, [folded.contains(phrase) for phrase in BOILERPLATE])


def good_lines(text: Column, lines: Column) -> Column:
    """Lines that pass.  Lines of a text without any symbol, separator or phrase can fail by the other rules only; navigation
    words stand without an end mark, so they fail by that already."""
    some = reduce(or_, [text.contains(c) for c in SYMBOLS + SEPARATORS]) | boilerplate(text)
    return F.when(some, F.filter(lines, lambda x: ~line_fails(x))).otherwise(F.filter(lines, lambda x: ~(has_word(x) & plain_fails(x))))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base measures, ``clean_text``, ``lost`` (share of characters), ``base_failed`` and ``kept``."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "lost", "base_failed", "kept"]
    rest = [c for c in df.columns if c.lower() not in new]
    text = F.coalesce(F.col("__text"), F.lit(""))
    stage = df.select(*[df[c] for c in rest], df[text_col].cast("string").alias("__text"))
    stage = stage.select(*rest, text.alias("__text"), words(text).alias("__words"), F.split(text, "\n").alias("__lines"))
    n = F.size("__words")
    triples = F.slice(
        F.arrays_zip(F.col("__words").alias("a"), F.slice("__words", F.lit(2), n).alias("b"), F.slice("__words", F.lit(3), n).alias("c")),
        F.lit(1),
        F.greatest(n - 2, F.lit(0)),
    )
    ordered = F.sort_array(F.transform(triples, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("p"))))
    stage = stage.select(
        *rest,
        "__text",
        n.cast("long").alias("n_words"),
        ordered.alias("__grams"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.filter("__lines", has_word).alias("__worded"),
        good_lines(F.col("__text"), F.col("__lines")).alias("__good"),
    )
    m = F.size("__grams")
    pairs = F.filter(
        F.slice(F.arrays_zip(F.col("__grams").alias("s"), F.slice("__grams", F.lit(2), m).alias("t")), F.lit(1), F.greatest(m - 1, F.lit(0))),
        lambda x: x["s"]["h"] == x["t"]["h"],
    )
    stage = stage.select(
        *rest,
        "__text",
        "n_words",
        "word_chars",
        pairs.alias("__pairs"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
        F.array_join("__good", "\n").alias("clean_text"),
    )
    stage = stage.withColumn(
        "__at",
        F.sort_array(F.concat(F.transform("__pairs", lambda x: x["s"]["p"]), F.transform("__pairs", lambda x: x["t"]["p"]))),
    )
    zipped = F.arrays_zip(F.col("__at").alias("s"), F.slice("__at", F.lit(2), F.size("__at")).alias("t"))
    covered = F.aggregate(zipped, F.lit(0).cast("long"), lambda acc, x: acc + F.least(F.lit(3), F.coalesce(x["t"] - x["s"], F.lit(3))))
    whole = F.length("__text")
    stage = stage.select(
        *rest,
        "n_words",
        "word_chars",
        removed(F.col("__text"), SYMBOLS).alias("n_symbols"),
        "n_dup_lines",
        covered.alias("n_repeat_words"),
        "clean_text",
        F.when(whole > 0, (whole - F.length("clean_text")) / whole).otherwise(F.lit(0.0)).alias("lost"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stage.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= MAX_LOST))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ta.table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = f"""
with t as (select doc_id, row_number() over () as row, coalesce(text, '') as text from documents),
w as (select row, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as ws from t),
p as (select row, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
g as (select row, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram from p window o as (partition by row order by i)),
d as (select row, i from g where gram is not null qualify count(*) over (partition by row, gram) > 1),
r as (select row, count(distinct i + k) as n from d, (select unnest([0, 1, 2]) as k) group by row),
l as (select row, string_split(text, chr(10)) as lines from t),
q as (select row, list_filter(lines, lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as worded,
        list_filter(lines, lambda x: not (regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]') and (
          length(x) - length(translate(x, '{SYMBOLS}', '')) > length(x) * {MAX_SYMBOLS}
          or right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '{CLOSING.replace("'", "''")}'), 1) not in ('{"', '".join(ENDS)}')
          or not regexp_matches(x, '\\p{{L}}') or regexp_matches(x, '{NAVIGATION}')
          or length(x) - length(translate(x, '{SEPARATORS}', '')) >= 2
          or {" or ".join(f"contains(lower(x), '{phrase.replace(chr(39), chr(39) * 2)}')" for phrase in BOILERPLATE)}))) as good from l),
b as (select t.doc_id, len(ws) as n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols, len(worded) - len(list_distinct(worded)) as n_dup_lines,
        coalesce(r.n, 0) as n_repeat_words,
        case when length(text) > 0 then (length(text) - length(array_to_string(good, chr(10)))) / length(text) else 0 end as lost
      from t join w using (row) join q using (row) left join r using (row))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and lost <= {MAX_LOST} as kept
from b
"""
