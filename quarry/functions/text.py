"""Text functions as Spark Column expressions (JVM-side, no Python per row).

Two tokenizers exist and must stay separate:
* ``norm_tokens`` / ``normalize`` -- the metric normaliser (lower-case, ASCII punctuation
  deleted, Unicode whitespace collapsed, articles dropped).
* ``sampler_tokens`` -- the sampler tokenizer (every non-alphanumeric char is a separator).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference behaviour) -------------------------------
# The 32 ASCII punctuation characters deleted by the normaliser.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Articles dropped by the normaliser.
ARTICLES = ("a", "an", "the")
# Characters that count as whitespace for the normaliser (Python str.isspace set).
# Java's \s is ASCII-only, so the class is spelled out; RE2 reads the same text.
WS_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
# Sampler tokenizer: anything that is not a Unicode letter or number separates tokens.
NON_ALNUM_RUN = "[^\\p{L}\\p{N}]+"
# Prefix sums for the ndcg denominator are built from 1/log2(i+2) on the driver.


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_str(x) -> Column:
    """null -> '' (the reference's _safe_str)."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def norm_tokens(x) -> Column:
    """Normalised metric tokens of a text column (array<string>)."""
    s = F.translate(F.lower(safe_str(x)), PUNCTUATION, "")
    parts = F.split(s, WS_RUN)
    return F.filter(parts, lambda t: (t != F.lit("")) & ~t.isin(*ARTICLES))


def normalize(x) -> Column:
    """Normalised metric string: tokens joined by one space."""
    return F.array_join(norm_tokens(x), " ")


def normalized_text(x) -> Column:
    """``normalize`` by regular expressions alone, which stay in generated code where whole texts are
    compared and tokens are not needed."""
    s = F.translate(F.lower(safe_str(x)), PUNCTUATION, "")
    spaced = F.concat(F.lit(" "), F.regexp_replace(s, WS_RUN, " "), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, "(?<= )(?:" + "|".join(ARTICLES) + ") ", ""))


def split_normalized(norm_col) -> Column:
    """Tokens of an already normalised string (cheaper than re-normalising)."""
    return F.filter(F.split(_c(norm_col), " "), lambda t: t != F.lit(""))


def sampler_tokens(x) -> Column:
    """Sampler tokenizer: lower-case, every non-alphanumeric char separates."""
    s = F.lower(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), NON_ALNUM_RUN, " "))
    return F.filter(F.split(s, " "), lambda t: t != F.lit(""))


def whitespace_words(x) -> Column:
    """Python str.split(): split on Unicode whitespace runs, no empty tokens."""
    return F.filter(F.split(F.coalesce(_c(x).cast("string"), F.lit("")), WS_RUN), lambda t: t != F.lit(""))


def is_upper_initial(word: Column) -> Column:
    """First character is an upper-case cased letter (Python ``t[:1].isupper()``)."""
    ch = F.substring(word, 1, 1)
    return (F.upper(ch) == ch) & (F.lower(ch) != ch)


def token_jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two token arrays; 0 if either side is empty."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(sa, sb))
    union = F.size(F.array_union(sa, sb))
    return F.when((F.size(sa) == 0) | (F.size(sb) == 0), F.lit(0.0)).otherwise(inter / union)


def rouge_tokens(x) -> Column:
    """ROUGE-n tokenizer: lower-case, runs of [a-z0-9] only."""
    s = F.regexp_replace(F.lower(safe_str(x)), "[^a-z0-9]+", " ")
    return F.filter(F.split(s, " "), lambda t: t != F.lit(""))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams of a token array, joined by a single space."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - n + 1),
            lambda i: F.array_join(F.slice(tokens, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))
