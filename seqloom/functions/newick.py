"""Trees as Newick text: reading, splits with lengths, random birth-death trees."""

from __future__ import annotations

import re

from seqloom.functions.rng import Random

TOKEN = re.compile(r"\s*([(),;]|'(?:[^']|'')*'|[^\s(),;:']+)?\s*(?::\s*([-+0-9.eE]+))?")


def read(text: str) -> tuple[list[int], list[str], list[float]]:
    """(parent, name, length) of each node, parents before their children; the root's parent is -1."""
    parent, name, length = [-1], [""], [0.0]
    now, at = 0, 0
    text = re.sub(r"\[[^\]]*\]", "", text).strip()
    while at < len(text) and text[at] != ";":
        c = text[at]
        if c == "(" or c == ",":
            up = now if c == "(" else parent[now]
            parent.append(up)
            name.append("")
            length.append(0.0)
            now, at = len(parent) - 1, at + 1
        elif c == ")":
            now, at = parent[now], at + 1
        else:
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"unexpected {c!r} in a tree at {at}")
            if m[1]:
                name[now] = m[1].strip("'").replace("''", "'")
            if m[2]:
                length[now] = float(m[2])
            at = m.end()
    if now:
        raise ValueError("a tree ends within brackets")
    return parent, name, length


def splits(text: str) -> tuple[list[tuple[list[str], float]], int]:
    """([names on the side without the first name, length] of every edge, number of leaves); edges that part the leaves alike
    count together."""
    parent, name, length = read(text)
    below: list[set[str]] = [set() for _ in parent]
    inner = set(parent)
    for k in range(len(parent) - 1, -1, -1):
        if k not in inner:
            below[k].add(name[k])
        if parent[k] >= 0:
            below[parent[k]] |= below[k]
    whole = below[0]
    first = min(whole)
    out: dict[tuple[str, ...], float] = {}
    for k in range(1, len(parent)):
        side = below[k] if first not in below[k] else whole - below[k]
        if side:
            key = tuple(sorted(side))
            out[key] = out.get(key, 0.0) + length[k]
    return [(list(k), v) for k, v in sorted(out.items())], len(whole)


def birth_death(taxa: int, birth: float = 1.0, death: float = 0.2, seed: int = 42) -> str:
    """A random tree of so many living tips: lineages split and end at the given rates; ended ones are left out."""
    rng = Random(seed)
    while True:
        parent, born, died, live = [-1], [0.0], [None], [0]
        time = 0.0
        while live and len(live) < taxa:
            time += rng.exponential(1 / ((birth + death) * len(live)))
            k = live.pop(rng.below(len(live)))
            died[k] = time
            if rng.uniform() * (birth + death) < birth:
                for _ in range(2):
                    parent.append(k)
                    born.append(time)
                    died.append(None)
                    live.append(len(parent) - 1)
        if live:
            break
    time += rng.exponential(1 / ((birth + death) * len(live)))
    kids: dict[int, list[int]] = {}
    keep = set(live)
    for k in range(len(parent) - 1, 0, -1):
        if k in keep:
            keep.add(parent[k])
            kids.setdefault(parent[k], []).append(k)
    label = {k: f"t{i + 1}" for i, k in enumerate(sorted(live))}
    text: dict[int, str] = {}
    for k in sorted(keep, reverse=True):  # children have higher numbers than their parents
        end = time if died[k] is None else died[k]
        own = kids.get(k, [])
        if k in label:
            text[k] = f"{label[k]}:{end - born[k]:.6f}"
        elif len(own) == 1 and k:  # a lineage with one living side goes on through it
            name, _, length = text[own[0]].rpartition(":")
            text[k] = f"{name}:{float(length) + end - born[k]:.6f}"
        else:
            text[k] = f"({','.join(text[c] for c in sorted(own))}):{end - born[k]:.6f}"
    return text[0].rpartition(":")[0] + ";"
