"""Run a caller-supplied annotator over a DataFrame, and the annotation jobs
built on it (pairwise rating, summary, first-level tag, second/third-level tag,
flat tags, edit).

``annotate`` is a ``mapInArrow``: each task receives Arrow batches of its
partition, cuts them into groups of ``batch_size`` prompts and calls the
function on them (optionally from a small thread pool, like concurrent calls
to a service). Only the prompts of a group become Python objects, other columns
pass as they are. A call that raises yields the failure sentinel for that prompt;
nothing is collected to the driver. Partition count bounds the parallelism
towards the service.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FAILED
from ..functions import prompts as PR
from ..functions import replies as RP


def annotate(df: DataFrame, fn: Callable, prompt_col: str = "prompt", reply_col: str = "reply",
             batch_size: int = 25, threads: int = 1, vectorized: bool = False,
             partitions: int | None = None, class_col: str | None = None,
             error_col: str | None = None, keep_prompt: bool = True) -> DataFrame:
    """Add ``reply_col`` = fn(prompt) for every row, or fn(prompt, class) with
    ``class_col`` (for example the prompt's size class, to pick a model by).
    ``error_col`` keeps the text of the exception of a failed call (and of the
    batch's, if that failed first). ``fn`` maps one prompt to
    one reply, or with ``vectorized=True`` a pandas Series of prompts to a
    Series of replies. Null prompts get a null reply. ``keep_prompt=False`` leaves the
    prompts out of the result, so that they do not cross back from Python.

    The input partitioning is kept; ``partitions`` spreads the prompts over that
    many tasks instead (the cost is per prompt, not per byte).

    Every action on the result calls ``fn`` again: write or checkpoint the
    annotated DataFrame before using it twice (the flows in ``plans.flows``
    checkpoint each annotation stage)."""
    if partitions:
        df = df.repartition(partitions)
    added = [reply_col] + ([error_col] if error_col else [])
    kept = [f for f in df.schema.fields if keep_prompt or f.name != prompt_col]
    schema = T.StructType(kept + [T.StructField(c, T.StringType(), True)
                                              for c in added])

    def one(args):
        if args[0] is None:
            return None, None
        try:
            r = fn(*args)
            return None if r is None else str(r), None
        except Exception as e:  # a failed call is data, not a task failure
            return FAILED, f"{type(e).__name__}: {e}"

    def call(*columns: pd.Series) -> list:
        if vectorized:
            try:
                out = list(fn(*columns))
                if len(out) == len(columns[0]):
                    return [(None if r is None else str(r), None) for r in out]
                wrong = f"{len(out)} replies for {len(columns[0])} prompts"
            except Exception as e:
                wrong = f"{type(e).__name__}: {e}"
            # prompt by prompt; a prompt that fails again keeps what was wrong with the batch
            return [(r, e and f"{e}; batch: {wrong}") for r, e in map(one, zip(*columns))]
        elif threads > 1:
            from concurrent.futures import ThreadPoolExecutor
            with ThreadPoolExecutor(max_workers=threads) as pool:
                return list(pool.map(one, zip(*columns)))
        return [one(args) for args in zip(*columns)]

    given = [prompt_col] + ([class_col] if class_col else [])

    def run(batches):
        for batch in batches:
            step = _whole_groups(batch, batch_size)
            for at in range(0, batch.num_rows, step):
                part, out = batch.slice(at, step), []
                for start in range(0, part.num_rows, batch_size):
                    group = part.slice(start, batch_size)
                    out.extend(call(*[group.column(c).to_pandas() for c in given]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in kept]
                    + [pa.array([r[k] for r in out], pa.string()) for k in range(len(added))],
                    names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


#: About so many bytes of a batch go back at once.
PART_BYTES = 4 << 20


def _whole_groups(batch: pa.RecordBatch, batch_size: int) -> int:
    """Rows of as many groups as hold about ``PART_BYTES``, one at least."""
    rows = PART_BYTES * batch.num_rows // max(1, batch.nbytes)
    return max(1, rows // batch_size) * batch_size


def rate_pairs(docs: DataFrame, pairs: DataFrame, task: str | Sequence[str], fn: Callable,
               templates: Mapping[str, str] | None = None, id_col: str = "doc_id",
               text_col: str = "text", expected_n: int | None = None, **kw) -> DataFrame:
    """Pairwise rating job: ``(task, pair_id, pair_ids, win, why, status)`` for
    every pair (rejected ones keep their status and null win). ``task`` may be a list:
    the texts of a pair are brought together once for the prompts of all tasks. With
    ``expected_n`` (the ``n`` recorded with the pair set) a different number
    of documents is refused."""
    from .pairs import pair_texts, require_pair_set
    if expected_n is not None:
        require_pair_set(expected_n, docs)
    templates = templates or PR.default_templates()
    t = pair_texts(pairs, docs, id_col, text_col)
    slots = {"text_1": "text_1", "text_2": "text_2"}
    prompts = F.array(*[F.struct(F.lit(name).alias("task"),
                                 PR.render(templates[name], slots).alias("prompt"))
                        for name in ([task] if isinstance(task, str) else task)])
    p = t.select("pair_id", "id_1", "id_2", F.inline(prompts))
    r = RP.parse_choice(annotate(p, fn, keep_prompt=False, **kw))
    return r.select("task", "pair_id", F.array("id_1", "id_2").alias("pair_ids"),
                    "win", "why", "status")


def summarize(docs: DataFrame, fn: Callable, templates: Mapping[str, str] | None = None,
              id_col: str = "doc_id", text_col: str = "text", max_chars: int | None = None,
              literal: bool = False, **kw) -> DataFrame:
    """``(instance_id, summary, status)``."""
    templates = templates or PR.default_templates()
    p = PR.render_prompt(docs.select(F.col(id_col).alias("instance_id"), text_col),
                         templates["summary"], text_col, max_chars).drop(text_col)
    v = RP.validate_summary(annotate(p, fn, keep_prompt=False, **kw), literal=literal)
    return v.select("instance_id", "summary", "status")


def tag_first_level(records: DataFrame, fn: Callable, templates: Mapping[str, str] | None = None,
                    text_col: str = "summary", max_chars: int | None = None,
                    literal: bool = False, **kw) -> DataFrame:
    """``(instance_id, summary, first_level_tag, first_level_explanation, status)``
    from summary records (the summary is the text that is tagged)."""
    templates = templates or PR.default_templates()
    p = PR.render_prompt(records.select("instance_id", "summary"), templates["tag_first_level"],
                         text_col, max_chars)
    v = RP.validate_first_level(annotate(p, fn, keep_prompt=False, **kw), literal=literal)
    return v.select("instance_id", "summary", "first_level_tag", "first_level_explanation", "status")


def tag_second_third(records: DataFrame, taxonomy: DataFrame, fn: Callable,
                     templates: Mapping[str, str] | None = None, text_col: str = "summary",
                     max_chars: int | None = None,
                    literal: bool = False, **kw) -> DataFrame:
    """Full tag records from first-level records and the taxonomy."""
    templates = templates or PR.default_templates()
    base = records.select("instance_id", "summary", "first_level_tag", "first_level_explanation")
    p = PR.render_subtree_prompt(base, taxonomy, templates["tag_second_third_level"], text_col,
                                 max_chars=max_chars)
    bad = p.filter(F.col("status") != "ok").withColumn("reply", F.lit(None).cast("string"))
    ok = annotate(p.filter(F.col("status") == "ok"), fn, keep_prompt=False, **kw)
    v = RP.validate_second_third(ok.drop("status"), taxonomy, literal=literal)
    bad = bad.select("instance_id", "summary", "first_level_tag",
                     F.lit(None).cast("string").alias("second_level_tag"),
                     F.lit(None).cast("string").alias("third_level_tag"),
                     F.col("first_level_explanation").alias("first_explanation"),
                     F.lit(None).cast("string").alias("second_third_explanation"), "status")
    good = v.select("instance_id", "summary", "first_level_tag", "second_level_tag",
                    "third_level_tag", F.col("first_level_explanation").alias("first_explanation"),
                    "second_third_explanation", "status")
    return good.unionByName(bad)


def tag_flat(docs: DataFrame, fn: Callable, templates: Mapping[str, str] | None = None,
             id_col: str = "doc_id", text_col: str = "text", max_chars: int | None = None,
             literal: bool = False, **kw) -> DataFrame:
    """``(instance_id, tags, status)`` with three-level tag paths."""
    templates = templates or PR.default_templates()
    p = PR.render_prompt(docs.select(F.col(id_col).alias("instance_id"), text_col),
                         templates["tag"], text_col, max_chars).drop(text_col)
    v = RP.validate_flat_tags(annotate(p, fn, keep_prompt=False, **kw), literal=literal)
    return v.select("instance_id", "tags", "status")


def edit_documents(docs: DataFrame, fn: Callable, templates: Mapping[str, str] | None = None,
                   lang_col: str = "lang", text_col: str = "text", **kw) -> DataFrame:
    """Keeps the text and adds ``edited_text`` (null when the call failed)."""
    templates = templates or PR.default_templates()
    p = PR.render_edit_prompt(docs, templates, lang_col, text_col)
    r = annotate(p, fn, keep_prompt=False, **kw)
    return r.withColumn("edited_text", F.when(F.col("reply") != FAILED, F.col("reply"))).drop(
        "reply")
