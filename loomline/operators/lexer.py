"""Lines of source text with what comments and strings that began on earlier lines make of them.

A stretch of lines turns the lexical state before it into the state after it, so a stretch is a function on states, and functions compose. Long texts are cut into
blocks of lines; each block's function is computed on its own, the functions are composed in groups, groups of groups and so on, and the states before each block come back down
the same levels. So no task reads a whole file, and a file of any length splits.

States: 0 is code, 1 to m are the language's strings that go over lines, and m + d is a block comment of depth d. Where comments nest, a function is a list of states that goes on with slope 1
beyond its end: a block that closes k comments cannot end one of greater depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of
from .graph import settled


@dataclass(frozen=True)
class Lexis:
    """What begins and ends comments and strings. long_strings go over lines, short_strings end with theirs; raw: strings where a backslash is a character like others; atom: a pattern of literals
    that may hold quotes."""

    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    nested: bool = False
    long_strings: tuple[str, ...] = ()
    short_strings: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    atom: str | None = None

    def __post_init__(self):
        marks = [("long", x) for x in self.long_strings] + [("short", x) for x in self.short_strings] + [("line", x) for x in self.line] + ([("block", self.block[0])] if self.block else [])
        marks.sort(key=lambda m: -len(m[1]))
        starts = ([self.atom] if self.atom else []) + [re.escape(x) for _, x in marks]
        object.__setattr__(self, "kinds", {x: kind for kind, x in marks})
        object.__setattr__(self, "starts", re.compile("|".join(starts)))
        object.__setattr__(self, "ends", {x: re.compile(re.escape(x) if x in self.raw else rf"(?s)(?:\\.|[^\\])*?{re.escape(x)}") for x in self.long_strings + self.short_strings})
        object.__setattr__(self, "turns", re.compile("|".join(re.escape(x) for x in (self.block or ())[0 if self.nested else 1 :])) if self.block else None)

    def string_end(self, mark: str, line: str, at: int) -> int:
        """Where the string ends that is open at a place of the line; -1: not on this line."""
        found = self.ends[mark].search(line, at) if mark in self.raw else self.ends[mark].match(line, at)
        return found.end() if found else -1

    def lex(self, line: str, state: int) -> tuple[int, str, str]:
        """(state after the line, its code with <LIT> for each string, the text of its comments)."""
        code, comment, at, m = [], [], 0, len(self.long_strings)
        while True:
            if state == 0:
                found = self.starts.search(line, at)
                if not found:
                    return 0, "".join([*code, line[at:]]), "".join(comment)
                code.append(line[at : found.start()])
                at, mark = found.end(), found.group()
                kind = self.kinds.get(mark)
                if kind == "line":
                    return 0, "".join(code), "".join([*comment, line[found.start() :]])
                if kind == "block":
                    state = m + 1
                    comment.append(mark)
                    continue
                code.append("<LIT>")
                if kind == "long":
                    state = 1 + self.long_strings.index(mark)
                    end = self.string_end(mark, line, at)
                    if end < 0:
                        return state, "".join(code), "".join(comment)
                    at, state = end, 0
                elif kind == "short":
                    end = self.string_end(mark, line, at)
                    at = len(line) if end < 0 else end
            elif state <= m:
                code.append("<LIT>")
                end = self.string_end(self.long_strings[state - 1], line, at)
                if end < 0:
                    return state, "".join(code), "".join(comment)
                at, state = end, 0
            else:
                found = self.turns.search(line, at)
                if not found:
                    return state, "".join(code), "".join([*comment, line[at:]])
                comment.append(line[at : found.end()])
                at = found.end()
                state += 1 if found.group() == self.block[0] else -1
                state = 0 if state == m else state

    def function(self, lines: list[str]) -> list[int]:
        """The state after the lines for each state before them."""
        closers = sum(x.count(self.block[1]) for x in lines) if self.nested else 0
        out = []
        for state in range(len(self.long_strings) + 1 + (closers + 1 if self.block else 0)):
            for line in lines:
                state = self.lex(line, state)[0]
            out.append(state)
        return out


# Comment and string marks by language.
LANGUAGES = {
    "python": Lexis(line=("#",), long_strings=('"""', "'''"), short_strings=('"', "'")),
    "javascript": Lexis(line=("//",), block=("/*", "*/"), long_strings=("`",), short_strings=('"', "'")),
    "java": Lexis(line=("//",), block=("/*", "*/"), long_strings=('"""',), short_strings=('"', "'")),
    "go": Lexis(line=("//",), block=("/*", "*/"), long_strings=("`",), short_strings=('"', "'"), raw=("`",)),
    "rust": Lexis(line=("//",), block=("/*", "*/"), nested=True, long_strings=('"',), atom=r"'(?:\\[^']+|\\'|[^'\\])'"),
    "html": Lexis(block=("<!--", "-->")),
}


def applied(f: Column, state: Column) -> Column:
    """The state that a function gives; beyond its list it goes on with slope 1."""
    last = F.size(f) - 1
    return F.when(state <= last, F.get(f, F.least(state, last))).otherwise(F.get(f, last) + state - last)


def composed(first: Column, then: Column, nested: bool) -> Column:
    """First one function, then the other. Where comments nest, both lists' lengths are needed before the slope is 1 for sure."""
    last = F.size(first) - 1 + (F.size(then) - 1 if nested else 0)
    return F.transform(F.sequence(F.lit(0), last), lambda s: applied(then, applied(first, s)))


def states_before(functions: DataFrame, key: str, fan: int, nested: bool) -> DataFrame:
    """key, at, state: the state before each function of its key, in order of at (from 0). functions: key, at, f. A group holds at most `fan` functions."""
    top = functions.agg(F.max("at")).first()[0]
    sorted_fs = F.sort_array(F.collect_list(F.struct("at", "f"))).alias("fs")
    groups = functions.groupBy(key, F.expr(f"at div {fan}").alias("part")).agg(sorted_fs)
    if top is None or top < fan:
        groups = groups.withColumn("state", F.lit(0))
    else:
        whole = F.aggregate(F.slice("fs", 2, fan), F.get("fs", F.lit(0))["f"], lambda acc, x: composed(acc, x["f"], nested))
        above = states_before(settled(groups.select(key, F.col("part").alias("at"), whole.alias("f"))), key, fan, nested)
        groups = groups.join(above.withColumnRenamed("at", "part"), [key, "part"])
    none = F.array().cast("array<struct<at:bigint,state:int>>")
    step = lambda acc, x: F.struct(applied(x["f"], acc["state"]).alias("state"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["state"].alias("state")))).alias("out"))
    walked = F.aggregate("fs", F.struct(F.col("state").alias("state"), none.alias("out")), step, lambda acc: acc["out"])
    return groups.select(key, F.inline(walked))


def one_by_one(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The values of each row; only one row at a time is Python objects, which take several times the room of the batch."""
    own = [batch.column(c) for c in columns]
    return (tuple(c[i].as_py() for c in own) for i in range(batch.num_rows))


def lexed_lines(docs: DataFrame, key: str, text: str, language: str, block: int = 256, fan: int = 256) -> DataFrame:
    """key, line_no (from 1), line, state (before the line), code (comments gone, strings as <LIT>) and comment (the comments' text), of every line.

    A key has one text, and so has null; null and empty texts have no lines. Only texts of more than one block of lines are read twice; a line inside a long string has the code <LIT>.
    """
    lexis = LANGUAGES[language]
    flat = docs.select(F.struct(F.col(key).alias("key")).alias("key"), lines_of(F.col(text)).alias("ls")).filter(F.size("ls") > 0)
    starts = F.sequence(F.lit(0), F.expr(f"(size(ls) - 1) div {block}"))
    blocks = flat.select("key", F.col("ls"), (F.size("ls") > block).alias("more"), F.explode(starts).alias("at"))
    blocks = blocks.select("key", F.col("at").cast("long").alias("at"), "more", F.slice("ls", F.col("at").cast("int") * block + 1, block).alias("lines"))
    of_key = f"key {blocks.schema['key'].dataType.simpleString()}"

    def functions(batches):
        for batch in batches:
            made = (lexis.function(some) for (some,) in one_by_one(batch, "lines"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.int32()), size=batch.num_rows)], ["key", "at", "f"])

    long_ones = settled(blocks.filter("more").select("key", "at", "lines").mapInArrow(functions, f"{of_key}, at long, f array<int>"))
    open_ones = states_before(long_ones, "key", fan, lexis.nested).filter("state <> 0")
    begun = blocks.select("key", "at", "lines").join(open_ones, ["key", "at"], "left").select("key", "at", "lines", F.coalesce("state", F.lit(0)).alias("state"))

    def lines(batches):
        for batch in batches:
            for i, (at, some, state) in enumerate(one_by_one(batch, "at", "lines", "state")):
                states, codes, comments = [], [], []
                for line in some:
                    states.append(state)
                    state, code, comment = lexis.lex(line, state)
                    codes.append(code)
                    comments.append(comment)
                keys = batch.column("key").take(pa.array([i] * len(some), pa.int64()))
                numbers = pa.array(range(at * block + 1, at * block + 1 + len(some)), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, numbers, pa.array(some, pa.string()), pa.array(states, pa.int32()), pa.array(codes, pa.string()), pa.array(comments, pa.string())], ["key", "line_no", "line", "state", "code", "comment"])

    out = begun.mapInArrow(lines, f"{of_key}, line_no long, line string, state int, code string, comment string")
    return out.select(F.col("key.key").alias(key), "line_no", "line", "state", "code", "comment")
