"""Small inputs and brute-force versions that share nothing with the operators."""

import hashlib
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def documents(spark, texts, extra=""):
    """Texts, or (doc_id, text) pairs, as documents."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, None if i == 1 else "en", "s", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS + extra)


def awkward():
    """Texts every operator has to take."""
    return [
        "plain words of an ordinary text that is neither long nor short, said twice",
        None, "", " ", "\n\t  ", "a", "é", "plain words of an ordinary text that is neither long nor short, said twice",
        "word " * 30_000, "x" * 60_000, "7" * 20_000, "a@" * 5_000, "\u0000 nul and \U0001f600 emoji   line", "Ünïcödé ßtraße 漢字かな交じり文 العربية",
        "A b C d E f G h I j K l M n O p", "a b c d e f g h i j k l m n o p",
    ]


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))
