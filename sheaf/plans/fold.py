"""The operations of a job as one fold over its operation array, inside the job's row.

The fold carries the job's artifacts by name. An artifact is a list of parts,
each a reference to an input of the job: ``i`` (the input's number), ``w`` (each
page is cut to so many characters; null: whole) and ``first`` (only the first
page). So the fold needs names, types and verdicts alone, never a text:

    an input            one whole part of itself
    convert_to_pdf      the parts of its source
    merge_pdfs          the parts of its sources, one after the other
    thumbnail           the first page of its source, or every page, cut to its width

What an operation gives (sizes, pages, Markdown) is computed afterwards from
its parts and the texts of the inputs. The plan is the same for every job,
whatever its operations are and however many different lists of them there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import chunks
from ..operators.pages import DEFAULT_WIDTH
from ..schema import OP_TYPES

RAN, SKIPPED, UNKNOWN, MISSING = "ran", "skipped", "unknown", "missing"

PARTS = "array<struct<i:int,w:int,first:boolean>>"
OP = ("struct<op_index:int,op_name:string,op_type:string,inputs:array<string>,width:int,dpi:int,"
      "format:string,pages:string>")
ARTS = f"array<struct<name:string,file:boolean,parts:{PARTS}>>"
THREAT = "struct<name:string>"
OUT = f"array<struct<op:{OP},state:string,file:boolean,parts:{PARTS},threat:{THREAT}>>"
INPUTS = f"array<struct<name:string,bucket:string,key:string,content_type:string,text:string,threat:{THREAT}>>"


def whole(parts: Column) -> Column:
    """An input as it is stored: what is known of the file holds for it."""
    p = F.get(parts, F.lit(0))
    return (F.size(parts) == 1) & p["w"].isNull() & ~p["first"]


# One operation: its sources among the artifacts so far, what becomes of it, then its verdict and the gate.
# (One expression text: hundreds of single calls to build it would take longer than the jobs of a small run.)
_STEP = """transform(transform(
  array(named_struct('found', transform(op.inputs, r -> try_element_at(filter(acc.arts, a -> a.name = r), -1)))),
  s -> named_struct('found', s.found, 'state',
    CASE WHEN acc.gate THEN '{skipped}' WHEN op.op_type IS NULL THEN '{unknown}'
         WHEN coalesce(size(op.inputs), 0) <= 0 OR exists(s.found, a -> a IS NULL) THEN '{missing}'
         WHEN op.op_type NOT IN ({types}) THEN '{unknown}' ELSE '{ran}' END)),
  s -> named_struct('state', s.state, 'file', get(s.found, 0).file, 'parts', cast(CASE
    WHEN s.state != '{ran}' THEN NULL
    WHEN op.op_type = 'merge_pdfs' THEN flatten(transform(s.found, a -> a.parts))
    WHEN op.op_type = 'thumbnail' THEN transform(
      CASE WHEN op.pages = 'all' THEN get(s.found, 0).parts ELSE slice(get(s.found, 0).parts, 1, 1) END,
      p -> named_struct('i', p.i, 'w', least(p.w, CASE WHEN op.width > 0 THEN op.width ELSE {width} END),
                        'first', p.first OR NOT op.pages <=> 'all'))
    ELSE get(s.found, 0).parts END AS {parts})))"""

_SETTLED = """transform(transform({step},
  s -> named_struct('now', s, 'scan', op.op_type <=> 'scan' AND s.state = '{ran}', 'threat', CASE
    WHEN op.op_type <=> 'scan' AND s.state = '{ran}' THEN CASE
      WHEN size(s.parts) = 1 AND get(s.parts, 0).w IS NULL AND NOT get(s.parts, 0).first
      THEN get({threats}, get(s.parts, 0).i) ELSE try_element_at({derived}, op.op_index) END END)),
  s -> named_struct(
    'arts', CASE WHEN s.now.state = '{ran}' AND op.op_type IN ('convert_to_pdf', 'merge_pdfs', 'thumbnail')
      THEN concat(acc.arts, cast(array(named_struct('name', op.op_name, 'file', false, 'parts', s.now.parts)) AS {arts}))
      ELSE acc.arts END,
    'gate', acc.gate OR (op.op_type <=> 'scan' AND s.now.state = '{missing}') OR (s.scan AND {bad}),
    'out', concat(acc.out, cast(array(named_struct('op', op, 'state', s.now.state, 'file', s.now.file,
                                                   'parts', s.now.parts, 'threat', s.threat)) AS {out}))))"""


def operations(ops: str, names: str, threats: str, derived: str, scanning: bool) -> Column:
    """What becomes of every operation, in order (``OUT``); the arguments are SQL expressions.

    names: input names; threats: per input the first signature its file holds, or null; derived:
    map of operation number to the same for scans of anything but a stored file; scanning: False
    without a scanner, when every scan fails.
    """
    fixed = {"skipped": SKIPPED, "unknown": UNKNOWN, "missing": MISSING, "ran": RAN, "width": DEFAULT_WIDTH,
             "types": ", ".join(f"'{t}'" for t in OP_TYPES), "parts": PARTS, "arts": ARTS, "out": OUT,
             "threats": threats, "derived": derived, "bad": "s.threat IS NOT NULL" if scanning else "true"}
    settled = _SETTLED.format(step=_STEP.format(**fixed), **fixed)
    first = ("transform({}, (n, i) -> named_struct('name', n, 'file', true, 'parts', "
             "array(named_struct('i', i, 'w', cast(null AS int), 'first', false))))").format(names)
    return F.expr(f"aggregate({ops}, named_struct('arts', cast({first} AS {ARTS}), 'gate', false, "
                  f"'out', cast(array() AS {OUT})), (acc, op) -> get({settled}, 0)).out")


def _page_list(text: Column, image: Column, p: Column, page_chars: int) -> Column:
    """The pages of one part."""
    first = F.array(F.when(image, text).otherwise(F.substring(text, 1, page_chars)))
    pages = F.when(p["first"], first).when(image, F.array(text)).otherwise(chunks(text, page_chars))
    return F.when(p["w"].isNull(), pages).otherwise(F.transform(pages, lambda x: F.substring(x, F.lit(1), p["w"])))


class Parts:
    """Columns over the parts of an artifact (array ``parts``) and the job's inputs (array ``ins``)."""

    def __init__(self, ins: Column, parts: Column, page_chars: int):
        self.ins, self.parts, self.n = ins, parts, page_chars

    def _text(self, p: Column) -> Column:
        return F.get(self.ins, p["i"])["text"]

    def _image(self, p: Column) -> Column:
        return F.coalesce(F.get(self.ins, p["i"])["content_type"], F.lit("")).startswith("image/")

    def _sum(self, of, kind: str) -> Column:
        return F.aggregate(F.transform(self.parts, of), F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))

    def pages(self) -> Column:
        return F.flatten(F.transform(self.parts, lambda p: _page_list(self._text(p), self._image(p), p, self.n)))

    def n_pages(self) -> Column:
        def count(p):
            cut = F.greatest(F.lit(1), F.ceil(F.length(self._text(p)) / F.lit(self.n)).cast("int"))
            return F.when(p["first"] | self._image(p), F.lit(1)).otherwise(cut)
        return self._sum(count, "int")

    def size(self) -> Column:
        def octets(p):
            pages = _page_list(self._text(p), self._image(p), p, self.n)
            return F.when(p["w"].isNull() & ~p["first"], F.octet_length(self._text(p))).otherwise(
                F.aggregate(pages, F.lit(0), lambda a, x: a + F.octet_length(x)))
        return self._sum(octets, "bigint")

    def page_sizes(self) -> Column:
        return F.transform(self.pages(), lambda x: F.octet_length(x).cast("bigint"))

    def first_size(self) -> Column:
        """Bytes of the first page, which is all that is cut."""
        p = F.get(self.parts, F.lit(0))
        text = self._text(p)
        page = F.when(self._image(p), text).otherwise(F.substring(text, 1, self.n))
        return F.octet_length(F.when(p["w"].isNull(), page).otherwise(F.substring(page, F.lit(1), p["w"]))).cast("bigint")

    def text(self) -> Column:
        def of(p):
            pages = _page_list(self._text(p), self._image(p), p, self.n)
            return F.when(p["w"].isNull() & ~p["first"], self._text(p)).otherwise(F.array_join(pages, ""))
        return F.array_join(F.transform(self.parts, of), "")
