"""Taxonomies from name dumps and from the binary form; both are small, and read on the driver."""

from __future__ import annotations

import os
import struct
from collections import defaultdict

from cladeframe.functions.names import RANK_CODES

#: Layout of the binary form. Magic, three little-endian 64-bit counts, nodes of seven 64-bit fields, two blobs of NUL-ended strings.
MAGIC, NODE = b"K2TAXDAT", struct.Struct("<7Q")
FIELDS = ("ord", "pct_fragments", "num_fragments_clade", "num_fragments_direct", "rank_code", "taxon_id", "name", "indent", "minimizer_count", "distinct_minimizer_count")
SCHEMA = "ord long, pct_fragments double, num_fragments_clade long, num_fragments_direct long, rank_code string, taxon_id long, name string, indent int, minimizer_count long, distinct_minimizer_count long"


def _entry(k: int, rank: str, taxon: int, name: str, depth: int) -> tuple:
    return k, 0.0, 0, 0, RANK_CODES.get(rank, "--"), taxon, name, 2 * depth, None, None


def read_binary(path: str) -> list[tuple]:
    with open(path, "rb") as f:
        return parse_binary(f.read())


def parse_binary(data: bytes) -> list[tuple]:
    """Report entries in pre-order. Nodes without an outer id are skipped and their children take their depth."""
    if data[:8] != MAGIC:
        raise ValueError("not a binary taxonomy: bad magic")
    if len(data) < 32:
        raise ValueError("binary taxonomy is cut short")
    nodes, names_size, ranks_size = struct.unpack_from("<3Q", data, 8)
    if 32 + nodes * NODE.size + names_size + ranks_size > len(data):
        raise ValueError("binary taxonomy is smaller than its header says")
    if nodes < 2:
        raise ValueError("binary taxonomy has no root")
    at = 32 + nodes * NODE.size
    names, ranks = data[at : at + names_size], data[at + names_size : at + names_size + ranks_size]
    text = lambda blob, k: blob[k : end if (end := blob.find(b"\0", k)) >= 0 else len(blob)].decode() if k < len(blob) else ""
    out, seen, todo = [], set(), [(1, 0)]
    while todo:
        k, depth = todo.pop()
        if k in seen:
            raise ValueError("binary taxonomy has a cycle")
        seen.add(k)
        _, first, count, name, rank, outer, _ = NODE.unpack_from(data, 32 + k * NODE.size)
        if count and (first == 0 or first + count > nodes):
            raise ValueError("binary taxonomy has children out of range")
        if outer > 0xFFFFFFFF:
            raise ValueError("binary taxonomy has a taxon ID beyond 32 bits")
        if outer:
            out.append(_entry(len(out), text(ranks, rank), outer, text(names, name), depth))
        todo += [(c, depth + bool(outer)) for c in range(first + count - 1, first - 1, -1)] if count else []
    return out


def _cells(lines):
    for line in lines:
        yield [c.strip() for c in line.split("|")]


def read_dump(folder: str) -> list[tuple]:
    """parse_dump of taxonomy/nodes.dmp and names.dmp."""
    at = os.path.join(folder, "taxonomy")
    with open(os.path.join(at, "nodes.dmp"), encoding="utf-8") as nodes, open(os.path.join(at, "names.dmp"), encoding="utf-8") as names:
        return parse_dump(nodes, names)


def parse_dump(node_lines, name_lines) -> list[tuple]:
    """Report entries in pre-order, children by id; short and unparsable lines are skipped."""
    names = {int(c[0]): c[1] for c in _cells(name_lines) if len(c) > 3 and c[0].isdigit() and c[3] == "scientific name"}
    children, ranks = defaultdict(list), {}
    for c in _cells(node_lines):
        if len(c) < 3 or not (c[0].isdigit() and c[1].isdigit()):
            continue
        node, parent = int(c[0]), int(c[1])
        if node in ranks:
            raise ValueError(f"duplicate taxon ID {node} in nodes.dmp: the taxonomy would have a cycle")
        ranks[node] = c[2]
        if node != parent:
            children[parent].append(node)
    if 1 not in ranks:
        raise ValueError("nodes.dmp has no root 1")
    out, seen, todo = [], set(), [(1, 0)]
    while todo:
        node, depth = todo.pop()
        if node in seen:
            raise ValueError("nodes.dmp has a cycle")
        seen.add(node)
        out.append(_entry(len(out), ranks.get(node, "no rank"), node, names.get(node, ""), depth))
        todo += [(c, depth + 1) for c in sorted(children[node], reverse=True)]
    return out


def read_database(folder: str) -> list[tuple]:
    """The binary form if the folder has it, else the dumps."""
    binary = os.path.join(folder, "taxo.k2d")
    return read_binary(binary) if os.path.exists(binary) else read_dump(folder)
