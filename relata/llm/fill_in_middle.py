"""Fill-in-the-middle: texts cut at word boundaries and put in another order for training.

A text is a row of units, `[A-Za-z]+|[^A-Za-z]`. The first four groups of eight
digits of the SHA-256 of seed and id, as numbers h1 to h4, decide on it: h1 and
h2 give the two cuts, h3 whether it stays plain, h4 which of two orders it takes.

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text

The work is one Arrow-batched pandas UDF and no shuffle. It keeps the end of
each unit in a compact array of four bytes a unit, so two look-ups cut a text
and the units themselves are never made; `restored` is a second one that
rebuilds the text from output and form alone.

Defined results: a null text counts as empty, and an empty text is plain with
zero units; a text in which a sentinel occurs is plain, so what is read back is
exact; a null id is seeded as an empty one; repeated rows each get their row;
equal cuts leave the middle empty; a very long text costs four bytes a unit
above its own size; extra columns are carried and not read, and the result is
one struct column whose name is changed by underscores if it is taken.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.frames import fresh, table

SEED = 1
#: Percent of texts that are cut, and percent of those that take the order spm.
RATE = 90
SPM = 20
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
_RESULT = "output string, form string, n long, prefix_chars long, middle_chars long, output_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in _UNIT.finditer(text)))


def numbers(seed: int | str, key: str) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))  # type: ignore[return-value]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transformed(key: str, text: str, seed: int | str, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple:
    """Output, form, number of units, and code points of prefix and middle."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = numbers(seed, key)
    if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
        return text, "plain", n, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    p, s, m = sentinels
    if h4 % 100 < spm:
        return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", "spm", n, a, b - a
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", "psm", n, a, b - a


def original(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text that `transformed` was given."""
    if form == "plain":
        return output
    p, s, m = sentinels
    rest, _, middle = output.rpartition(m)
    if form == "psm":
        prefix, _, suffix = rest[len(p) :].partition(s)
    else:
        suffix, _, prefix = rest[len(s) :].partition(p)
    return prefix + middle + suffix


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels of which none begins within another or itself, so that no join of text and sentinel makes one anew."""
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed, none of them empty")
    for x in sentinels:
        for y in sentinels:
            if any(y.startswith(x[k:]) or x[k:].startswith(y) for k in range(1, len(x))):
                raise ValueError(f"{y!r} can begin within {x!r}: a text could not be read back")
    return tuple(sentinels)


def fim(id_col: Column, text_col: Column, seed: int | str = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """Struct of output, form, n, prefix_chars, middle_chars and output_sha256; `seed` comes before a colon and the id as text."""
    marks = _checked(sentinels)

    @F.pandas_udf(_RESULT)
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(key or "", text or "", seed, rate, spm, marks) for key, text in zip(keys, texts)]
        out = pd.DataFrame(rows, columns=["output", "form", "n", "prefix_chars", "middle_chars"], dtype=object)
        out["output_sha256"] = [digest(x) for x in out["output"]]
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(id_col.cast("string"), text_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """Struct of the text and its SHA-256, read back from output and form."""
    marks = _checked(sentinels)

    @F.pandas_udf("text string, sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [original(o, f, marks) for o, f in zip(outputs, forms)]
        return pd.DataFrame({"text": texts, "sha256": [digest(t) for t in texts]}, dtype=object)

    return run(output, form)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "fim", **options) -> tuple[DataFrame, str]:
    """docs with the struct of `fim` and the name of its column."""
    name = fresh(docs, name)
    return docs.withColumn(name, fim(docs[id_col], docs[text_col], **options)), name


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, name = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col(f"{name}.output"), F.col(f"{name}.form"))
    return done.select("doc_id", name, back.alias("back")).select("doc_id", *[f"{name}.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256")], F.col("back.sha256").alias("restored_sha256"))


ORACLE = """
with units as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d
  from documents
), seeded as (
  select doc_id, t, u, len(u) as n,
         cast('0x' || substr(d, 1, 8) as bigint) % (len(u) + 1) as c1, cast('0x' || substr(d, 9, 8) as bigint) % (len(u) + 1) as c2,
         cast('0x' || substr(d, 17, 8) as bigint) as h3, cast('0x' || substr(d, 25, 8) as bigint) as h4
  from units
), formed as (
  select doc_id, t, n,
         array_to_string(u[1:least(c1, c2)], '') as p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as m, array_to_string(u[greatest(c1, c2) + 1:], '') as s,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from seeded
)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(p || m || s) as restored_sha256
from formed
"""
