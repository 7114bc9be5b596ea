"""Spelling variants: words one edit apart, found by forward and backward minimal acyclic automata.

If two words differ by one code point inserted, deleted or replaced at place i (the length of their common prefix), they agree
exactly on the half before i or on the half after it. So each word is searched forwards, with its first half exact, and
backwards, with its second half exact; the other half is completed with one error. An automaton is a minimal acyclic one whose
edges carry the number of words that they pass over, so a match is a word's number (a perfect hash). Deletions from a run of
equal letters count at the run's last letter only, and a place belongs to one half: no pair is found twice, in either
direction, so none has to be sorted out afterwards.

At scale: words are dealt by their exact half and the longer length, sorted, and each task builds automata over whole groups of
some `GROUP` letters, one at a time. A group that is larger (a very common beginning or ending) is cut in two by the same
argument, with the first or the second half of what was open exact as well, and so on until groups are small; with one
letter open a group has no more words than the alphabet letters. What leaves a task is one row a word: how many words are near
it there, and the best of them. Forms are followed to the last by pointer jumping; their chains are short, as numbers grow
tenfold.

Defined results: null and empty texts have no words; a null id counts as the empty text in the digest; rows that repeat an id or
a text count each; an empty table gives no rows; other columns are ignored, whatever their names; of near words with equally many
occurrences the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_names, materialize, release

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Open letters of the words that one automaton holds, and of the groups that aren't cut further.
GROUP = 100_000
_FOUND = "word string, near long, form_n long, form string"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): lower-cased letter runs, of which one in 31 (by a digest of id and run) loses a letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(text_col, upper, upper.lower()), F.lit(f"[{LETTERS}]{{{shortest},}}"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


class Automaton:
    """Minimal acyclic automaton of sorted, distinct symbol sequences; edges[state][symbol] = (state, words passed over)."""

    def __init__(self, sequences: list) -> None:
        self.edges: list[dict] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}
        open_edges, open_final, via, before = [{}], [False], [], ()

        def close(depth: int) -> None:
            while len(via) > depth:
                edges, final, symbol = open_edges.pop(), open_final.pop(), via.pop()
                key = (final, *edges.items())
                state = known.get(key)
                if state is None:
                    known[key] = state = self._add(edges, final)
                open_edges[-1][symbol] = state

        for sequence in sequences:
            k = 0
            for a, b in zip(before, sequence, strict=False):
                if a != b:
                    break
                k += 1
            close(k)
            for symbol in sequence[k:]:
                open_edges.append({})
                open_final.append(False)
                via.append(symbol)
            open_final[-1] = True
            before = sequence
        close(0)
        self.root = self._add(open_edges[0], open_final[0])

    def _add(self, edges: dict, final: bool) -> int:
        number, numbered = int(final), {}
        for symbol, state in edges.items():
            numbered[symbol] = (state, number)
            number += self.words[state]
        self.edges.append(numbered)
        self.final.append(final)
        self.words.append(number)
        return len(self.edges) - 1

    def follow(self, state: int, number: int, symbols) -> tuple[int, int] | None:
        """State and word number after symbols that are matched exactly."""
        edges = self.edges
        for symbol in symbols:
            step = edges[state].get(symbol)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def one_error(self, state: int, number: int, rest: str, drop: list[bool]) -> list[int]:
        """Numbers of the words that complete `rest` from a state with one symbol replaced, or left out where `drop` says."""
        out, edges, final = [], self.edges, self.final
        for i, own in enumerate(rest):
            tail = rest[i + 1 :]
            for symbol, (then, skipped) in edges[state].items():
                if symbol != own:
                    end = self.follow(then, number + skipped, tail)
                    if end is not None and final[end[0]]:
                        out.append(end[1])
            if drop[i]:
                end = self.follow(state, number, tail)
                if end is not None and final[end[0]]:
                    out.append(end[1])
            step = edges[state].get(own)
            if step is None:
                break
            state = step[0]
            number += step[1]
        return out


def near_in(entries: list[tuple[str, str, str, int, int]], symbols=tuple) -> dict[str, list]:
    """word -> [near words, most occurrences among them, the word that has them], within sorted entries of whole groups.

    An entry is (head, rest, word, letters before the open part, occurrences); the head tells the direction and the exact part.
    """
    found: dict[str, list] = {}
    automaton = Automaton([(*symbols(head), *rest) for head, rest, *_ in entries])
    longest = 0
    for k, (head, rest, word, before, n) in enumerate(entries):
        if k == 0 or head != entries[k - 1][0]:
            j = k
            while j < len(entries) and entries[j][0] == head:
                j += 1
            group, longest = entries[k:j], max(len(e[2]) for e in entries[k:j])
            start = automaton.follow(automaton.root, 0, symbols(head)) if len(group) > 1 else None
        if start is None or len(word) < longest or len(word) != int(head[1 : head.index("|")]):
            continue
        after = before + len(rest)
        beside = word[after : after + 1]
        if head[0] == "f":
            drop = [a != b for a, b in zip(rest, rest[1:] + (beside or " "), strict=True)]
        else:
            drop = [a != b for a, b in zip(rest, beside + rest[:-1], strict=True)]
        for number in automaton.one_error(*start, rest, drop):
            other = entries[number]
            # words of equal length find each other; a shorter one is found by the longer only
            both = ((word, other[2], other[4]), (other[2], word, n))
            for w, v, m in both[: 1 + (len(other[2]) < len(word))]:
                best = found.get(w)
                if best is None:
                    found[w] = [1, m, v]
                else:
                    best[0] += 1
                    if m > best[1] or (m == best[1] and v < best[2]):
                        best[1], best[2] = m, v
    return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted entries, automaton by automaton."""
    held: list[tuple] = []
    size, long = 0, False

    def run() -> pa.RecordBatch:
        found = near_in(held, (lambda head: (head,)) if long else tuple)
        rows = [(w, *v) for w, v in found.items()]
        a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["word", "near", "form_n", "form"])

    for batch in batches:
        for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and entry[0] != held[-1][0] and (size > GROUP or long != (len(entry[0]) > 64)):
                yield run()
                held, size = [], 0
            if not held:
                long = len(entry[0]) > 64
            held.append(entry)
            size += len(entry[1]) + 1
    if held:
        yield run()
    release()


def _keyed(words: DataFrame) -> DataFrame:
    """Each word under its own length and the next, forwards and backwards: (way, longer, a, b, word, n) with a letters exact before, b after."""
    half = F.expr("int(longer / 2)")
    rows = words.withColumn("longer", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    ways = F.array(F.struct(F.lit("f").alias("way"), half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit("b").alias("way"), F.lit(0).alias("a"), (F.col("longer") - half).alias("b")))
    return rows.withColumn("_w", F.explode(ways)).select("word", "n", "longer", "_w.*")


def _with_head(rows: DataFrame) -> DataFrame:
    exact = F.expr("concat(left(word, a), '\\0', right(word, b))")
    head = F.concat("way", F.col("longer").cast("string"), F.lit("|"), F.when(F.col("way") == "b", F.reverse(exact)).otherwise(exact))
    open_part = F.expr("substring(word, a + 1, length(word) - a - b)")
    return rows.withColumn("head", head).withColumn("rest", F.when(F.col("way") == "b", F.reverse(open_part)).otherwise(open_part))


def _cut_large(rows: DataFrame, group: int) -> DataFrame:
    """Groups of more than `group` open letters are cut until they are small, or open in one place only."""
    done: list[DataFrame] = []
    while True:
        rows = _with_head(rows)
        large = rows.groupBy("head").agg(F.sum(F.length("rest")).alias("size"), F.max(F.expr("longer - a - b")).alias("gap"), F.count(F.lit(1)).alias("n_rows"))
        large = materialize(large.filter((F.col("size") > group) & (F.col("gap") > 1)).select("head", F.lit(True).alias("large")), "large")
        if not large.take(1):
            discard(large)
            return _union([*done, rows])
        # a few rows, at most one for each `group` letters; keys with many rows stay where they are if it is small enough
        few = large.count() <= 100_000
        marked = rows.join(F.broadcast(large) if few else large.hint("merge"), "head", "left")
        done.append(marked.filter("large is null").drop("large"))
        # the place lies in the second half of the open part, so its first is exact, or the other way round
        step = F.expr("int((longer - a - b) / 2)")
        cuts = F.array(F.struct((F.col("a") + step).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("longer") - F.col("a") - step).alias("b")))
        rows = marked.filter("large").withColumn("_c", F.explode(cuts)).select("word", "n", "longer", F.lit("f").alias("way"), "_c.*")
        rows = materialize(rows, "cut")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, form_n, form) of the words that have near ones: how many, and the most frequent of them."""
    entries = _cut_large(_keyed(words), group)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.select("head", "rest", "word", "a", "n").repartition(parts, "head").sortWithinPartitions("head", "rest")
    found = dealt.mapInArrow(_near, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("best")).select("word", "near", (-F.col("best.m")).alias("form_n"), "best.form")


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of rows (word, form), a word occurring once; by pointer jumping."""
    current = materialize(links.select("word", F.col("form").alias("root")), "links")
    while True:
        names = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        counted = current.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        moved = materialize(join_names(current, names, ["root"], "left", counted), "links")
        changed = moved.filter("next is not null").take(1)
        after = materialize(moved.select("word", F.coalesce("next", "root").alias("root")), "links")
        discard(current, moved)
        current = after
        if not changed:
            return current


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, group: int = GROUP) -> DataFrame:
    """One row a word: (word, form, root, n, n_near, form_n)."""
    words = materialize(word_counts(docs, id_col, text_col), "words")
    near = words.join(near_words(words, group).hint("merge"), "word", "left")
    is_form: Column = F.col("form_n") >= times * F.col("n")
    near = materialize(near.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "near")
    roots = last_forms(near.filter("form is not null"))
    out = near.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
    discard(words)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
