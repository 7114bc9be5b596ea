"""Text plans of plain lines, a batch at once: lines are taken apart by Arrow's expressions, only their levels go through a loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .parse import _NODE_TYPE, MAX_DEPTH, _classified

# The shapes of plain plans and lines. No white space but spaces and line feeds, and numbers that fit their columns.
_PLAIN = r"^[\n -~\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{3001}-\x{FFFF}]*$"
_NODE = (
    r"^(?:-> *)?(?P<words>[^()]*[^() ]) +\(cost=(?P<startup_cost>\d{1,15}(?:\.\d{1,15})?)\.\.(?P<total_cost>\d{1,15}(?:\.\d{1,15})?) +rows=(?P<est_rows>\d{1,15}) +width=(?P<width>\d{1,9})\)"
    r"(?: *\(actual(?: +time=\d{1,15}(?:\.\d{1,15})?\.\.(?P<actual_time_ms>\d{1,15}(?:\.\d{1,15})?))? +rows=(?P<actual_rows>\d{1,15}(?:\.\d{1,15})?) +loops=(?P<actual_loops>\d{1,9})\))?$"
)
_SEVERAL = r"^(?:Heap Blocks:|Buckets:|Sort Method:.*(?:Disk|Memory):)"


def _levels(first: list[int], level: list[int], node: list[bool]) -> tuple[list[bool], list[int], list[int], list[int], list[int]]:
    """Of each plan whether it is plain; of each line its owner or parent (a line; -1: none), its place below it, its depth (-1: no node, -2: not read)."""
    good, up, place, depth, children = [], [-1] * len(level), [0] * len(level), [-2] * len(level), [0] * len(level)
    for begin, end in zip(first, first[1:], strict=False):
        stack: list[int] = []
        root, fine = 0, begin < end and node[begin]
        for i in range(begin, end if fine else begin):
            at = level[i]
            while len(stack) > 1 and level[stack[-1]] >= at:
                stack.pop()
            if stack:
                if at <= root:
                    break
                up[i] = top = stack[-1]
                if not node[i]:
                    depth[i] = -1
                    continue
                place[i] = children[top]
                children[top] += 1
            else:
                root = at
            depth[i] = len(stack)
            stack.append(i)
            if len(stack) > MAX_DEPTH:
                fine = False
                break
        good.append(fine)
    return good, up, place, depth, children


def plain_texts(plans: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, pa.Array]:
    """(which of the plans are plain, their nodes as `parse_text` gives them); the others' rows mean nothing."""
    plain = pc.match_substring_regex(plans, _PLAIN).to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(pc.if_else(pa.array(plain), plans, ""), "\n")
    text, plan = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
    cut = pc.ascii_ltrim(text, " ")
    level = (pc.utf8_length(text).to_numpy() - pc.utf8_length(cut).to_numpy()) // 2
    text = pc.ascii_rtrim(cut, " ")
    some = pc.not_equal(text, "")
    text, keep = text.filter(some), some.to_numpy(zero_copy_only=False)
    level, plan = level[keep], plan[keep]
    is_node = pc.match_substring(text, "(cost=").to_numpy(zero_copy_only=False)
    first = np.searchsorted(plan, np.arange(len(plans) + 1))
    good, up, place, depth, children = _levels(first.tolist(), level.tolist(), is_node.tolist())
    up, place, depth, children = (np.array(x, dtype=np.int64) for x in (up, place, depth, children))

    nodes = np.flatnonzero(depth >= 0)
    own = text.take(pa.array(nodes))
    found = pc.extract_regex(own, _NODE)
    part = {f.name: pc.struct_field(found, f.name) for f in found.type}
    odd = set(plan[nodes[pc.is_null(found).to_numpy(zero_copy_only=False)]].tolist())
    coded = pc.dictionary_encode(part["words"])
    words = [w or "" for w in coded.dictionary.to_pylist()]
    unclear = np.array([w.endswith(("on", "using")) or w == "->" for w in words] + [False])
    code = pc.fill_null(coded.indices, len(words)).to_numpy()
    odd.update(plan[nodes[unclear[code]]].tolist())

    owned = np.flatnonzero(depth == -1)
    owned = owned[np.argsort(up[owned], kind="stable")]
    said = text.take(pa.array(owned))
    odd.update(plan[owned[pc.match_substring_regex(said, _SEVERAL).to_numpy(zero_copy_only=False)]].tolist())
    colon = pc.find_substring(said, ":").to_numpy()
    owned, said = owned[colon >= 0], said.filter(pa.array(colon >= 0))
    pairs = pc.ascii_trim(pc.split_pattern(said, ":", max_splits=1).flatten(), " ")
    key, value = (pairs.take(pa.array(np.arange(k, len(pairs), 2))) for k in (0, 1))
    keys = pc.dictionary_encode(key)
    marks = up[owned] * (len(keys.dictionary) + 1) + pc.fill_null(keys.indices, 0).to_numpy()
    _, seen, times = np.unique(marks, return_inverse=True, return_counts=True)
    odd.update(plan[owned[times[seen] > 1]].tolist())

    number = np.zeros(len(depth) + 1, dtype=np.int64)  # of nodes before each line
    number[1:] = np.cumsum(depth >= 0)
    before = number[first]  # of nodes before each plan
    parent = np.where(depth[nodes] > 0, number[up[nodes]], -1)
    kinds = [*zip(*map(_classified_with_space, words), strict=True)] or [()] * 4
    known = {n: pa.array([*kinds[k], None], pa.string()) for k, n in enumerate(("category", "kind", "table_name", "index_name"))}

    def numbers(name: str) -> pa.Array:
        return pc.cast(pc.if_else(pc.equal(part[name], ""), pa.scalar(None, pa.string()), part[name]), pa.float64() if name in ("startup_cost", "total_cost", "actual_time_ms", "actual_rows") else _NODE_TYPE.field(name).type)

    def of_child(k: int, name: str) -> pa.Array:
        from_ = np.full(len(nodes), -1)
        child = np.flatnonzero((parent >= 0) & (place[nodes] == k))
        from_[parent[child]] = child
        return numbers(name).take(pa.array(from_, mask=from_ < 0))

    def column(name: str) -> pa.Array:
        if name in known:
            return known[name].take(pa.array(code))
        if name == "node_id":
            return pa.array(number[nodes] - before[plan[nodes]] + 1, pa.int32())
        if name == "parent_id":
            return pa.array(parent - before[plan[nodes]] + 1, pa.int32(), mask=parent < 0)
        if name == "depth":
            return pa.array(depth[nodes], pa.int32())
        if name == "path":
            paths: list[list[int]] = []
            for p, k in zip(parent.tolist(), place[nodes].tolist(), strict=True):
                paths.append([*paths[p], k] if p >= 0 else [])
            return pa.array(paths, pa.list_(pa.int32()))
        if name == "props":
            offsets = np.searchsorted(up[owned], np.append(nodes, len(depth)))
            return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), key, value)
        if name == "original_text":
            return pc.replace_substring_regex(own, r"^-> *", "")
        if name == "actual_rows":
            return pc.cast(pc.floor(pc.add(numbers(name), 0.5)), pa.int64())
        side, _, field = name.partition("_")
        return of_child(("left", "right").index(side), field) if side in ("left", "right") else numbers(name)

    array = pa.StructArray.from_arrays([column(n) for n in names], fields=[_NODE_TYPE.field(n) for n in names])
    good = np.array(good, dtype=bool) & plain
    good[list(odd)] = False
    return good, pa.ListArray.from_arrays(pa.array(before, pa.int32()), array)


def _classified_with_space(words: str) -> tuple[str, str, str | None, str | None]:
    return _classified(f"{words} ")
