"""Trees of other Python libraries, to and from Newick text; the libraries are optional."""

from __future__ import annotations

import io

from stratabranch.sources import newick


def _convert(root, children, length, label) -> str:
    """Newick text of node objects, told how to ask them. Leaf order and a missing label's number follow
    the children's order."""
    links: dict[int, list[int]] = {}
    lengths, labels, stem = {}, {}, length(root)
    nodes, stack = [], [(root, None)]
    while stack:
        node, parent = stack.pop()
        k = len(nodes)
        nodes.append(node)
        links[k] = []
        if parent is not None:
            links[parent].append(k)
            lengths[k] = float(length(node) or 0.0)
        kids = list(children(node))
        if not kids and label(node):
            labels[k] = str(label(node))
        stack.extend((c, k) for c in reversed(kids))
    return newick.render(newick.number(links, 0, lengths, labels, float(stem or 0.0)))


def from_dendropy(tree) -> str:
    return _convert(tree.seed_node, lambda n: n.child_nodes(), lambda n: n.edge.length, lambda n: n.taxon.label if n.taxon else n.label)


def to_dendropy(text: str):
    import dendropy

    return dendropy.Tree.get(data=text, schema="newick", preserve_underscores=True)


def from_biopython(tree) -> str:
    return _convert(tree.root, lambda n: n.clades, lambda n: n.branch_length, lambda n: n.name)


def to_biopython(text: str):
    from Bio import Phylo

    return Phylo.read(io.StringIO(text), "newick")
