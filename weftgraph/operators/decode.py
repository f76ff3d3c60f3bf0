"""Text of walks: templates by intents, and a plain fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Templates by intents, in order; {nodeI} and {relationI} stand for the walk's labels and relations, {count} for the number of labels.
TEMPLATES: tuple[tuple[tuple[int, ...], str], ...] = (
    ((0,), "A {node0} is {node1}."),
    ((0, 1), "A {node0} is {node1}. This means {node0} {relation0} {node2}."),
    ((1, 2, 7), "{node0} {relation0} {node1}. This happens because {node2} {relation1} {node3}. For example, {node4}."),
    ((1,), "{node0} {relation0} {node1}."),
    ((2,), "The reason is that {node0} {relation0} {node1}."),
    ((4, 1), "Unlike {node0}, {node1} {relation0} {node2}."),
    ((3,), "As a result, {node0} {relation0} {node1}."),
    ((6, 8), "The key points are: {node0}, {node1}, and {node2}. In summary, {node3}."),
    ((7,), "For instance, {node0} {relation0} {node1}."),
    ((10,), "I'm not entirely certain, but {node0} appears to {relation0} {node1}."),
    ((11,), "Could you clarify whether you mean {node0} or {node1}?"),
    ((12,), "In summary, {node0} {relation0} {node1}."),
    ((1, 10), "While {node0} typically {relation0} {node1}, this may not always hold."),
    ((1, 4, 1), "{node0} {relation0} {node1}. However, {node2} {relation1} {node3}."),
    ((5,), "{node0} is similar to {node1}. Both {relation0} {node2}."),
    ((9,), "Is {node0} {relation0} {node1}?"),
    ((13,), "{node0} {relation0} {node1}, and more specifically, it has the following properties: {node2}."),
    ((14,), "Now, regarding {node0}: {node1} {relation0} {node2}."),
    ((15,), "Importantly, {node0} {relation0} {node1}. This is a critical point."),
    ((4, 1, 4), "Unlike {node0}, {node1} {relation0} {node2}. In contrast, {node3} {relation1} {node4}."),
    ((1, 5), "{node0} {relation0} {node1}. Similarly, {node2} {relation1} {node3}."),
    ((6, 12), "Related concepts include {node0}, {node1}, and {node2}. In summary, {node3} {relation0} {node4}."),
    ((4, 1, 7), "Unlike {node0}, {node1} {relation0} {node2}. For instance, {node3} {relation1} {node4}."),
    ((0, 4), "A {node0} is {node1}, unlike {node2} which {relation0} {node3}."),
    ((4, 1), "Unlike {node0}, {node1} stands in contrast."),
    ((4, 1), "Contrasting perspective: {node0}."),
    ((1, 5), "{node0} relates to {node1} similarly."),
    ((1, 5), "Related concept: {node0}."),
    ((6, 12), "Key concepts: {node0}, {node1}."),
    ((6, 12), "Concept: {node0}."),
    ((0,), "This relates to {node0}."),
)
# How relations are said in templates; others as they are written, with spaces for underscores.
PHRASES = {
    "is_a": "is a", "has_property": "has", "caused_by": "is caused by", "associated_with": "is associated with", "example_of": "is an example of", "part_of": "is part of",
    "synonym": "is synonymous with", "antonym": "is the opposite of", "temporal_coincident": "coincides with", "spatial_near": "is near", "linguistic_maps": "relates to",
    "RelatedTo": "is related to", "Antonym": "is the opposite of", "Synonym": "is synonymous with",
}
#: Templates of a table that are read at most.
MOST_TEMPLATES = 10_000


def templates_of(table: DataFrame) -> tuple[tuple[tuple[int, ...], str], ...]:
    """Templates of a table (ord, intents, template), in order, to be used with or in place of TEMPLATES."""
    rows = table.select("ord", "intents", "template").orderBy("ord").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return tuple((tuple(r.intents), r.template) for r in rows)


def phrase(relation: Column) -> Column:
    return F.replace(relation, F.lit("_"), F.lit(" "))


def said(relation: Column) -> Column:
    """A relation as templates say it."""
    table = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    return F.coalesce(table[relation], phrase(relation))


def _fill(template: str, labels: Column, relations: Column) -> Column:
    """The template with its places filled; null if the walk is too short for one of them."""
    out = F.replace(F.lit(template), F.lit("{count}"), F.size(labels).cast("string")) if "{count}" in template else F.lit(template)
    for i in range(20):
        if f"{{node{i}}}" in template:
            out = F.replace(out, F.lit(f"{{node{i}}}"), F.get(labels, F.lit(i)))
        if f"{{relation{i}}}" in template:
            out = F.replace(out, F.lit(f"{{relation{i}}}"), said(F.get(relations, F.lit(i))))
    return out


def mentioned(text: Column, labels: Column, path: Column) -> Column:
    """Nodes of the path, in its order, whose label stands in the text, in any case."""
    both = F.filter(F.arrays_zip(path.alias("node"), labels.alias("label")), lambda x: F.contains(F.lower(text), F.lower(x["label"])))
    return F.transform(both, lambda x: x["node"])


def render(intents: Column, labels: Column, relations: Column, templates: Sequence[tuple[tuple[int, ...], str]] = TEMPLATES, starters: Sequence[str] = ()) -> Column:
    """The first template with exactly these intents whose places the walk fills, else null; behind one of the starters, chosen by the sum of the intents."""
    text = F.coalesce(*[F.when(intents == F.array(*[F.lit(i) for i in k]), _fill(t, labels, relations)) for k, t in templates], F.lit(None).cast("string"))
    if not starters:
        return text
    at = F.pmod(F.aggregate(intents, F.lit(0), lambda s, x: s + x), F.lit(len(starters)))
    return F.concat(F.get(F.array(*[F.lit(x) for x in starters]), at), F.lit(" "), text)


def with_copied(text: Column, labels: Column, key: Column, probability: float = 0.3) -> Column:
    """Text that mentions none of its labels, in so many of 1 cases behind one of them; case and label are chosen by the md5 of the key."""
    from weftgraph.operators.evolution import uniform

    none = ~F.exists(labels, lambda x: F.contains(F.lower(text), F.lower(x)))
    picked = F.get(labels, F.floor(uniform(F.lit("label"), key) * F.size(labels)).cast("int"))
    return F.when(none & (F.size(labels) > 0) & (uniform(F.lit("copy"), key) <= probability), F.concat(picked, F.lit(" "), text)).otherwise(text)


def prompt(labels: Column, relations: Column, intents: Column) -> Column:
    """A generator's input: the intents' names and the walk."""
    from weftgraph.operators.plan import intent_names

    return F.concat(F.lit("generate: intents="), F.array_join(intent_names(intents), ","), F.lit(" walk="), F.array_join(labels, " -> "), F.lit(" relations="), F.array_join(F.transform(relations, phrase), ", "))


def fallback_text(labels: Column, relations: Column, words: int = 200) -> Column:
    """Labels and relations in turn, at most so many words."""
    pairs = F.flatten(F.transform(F.arrays_zip(labels.alias("l"), relations.alias("r")), lambda x: F.array(x["l"], phrase(x["r"]))))
    text = F.array_join(F.filter(pairs, lambda x: x.isNotNull()), " ")
    return F.array_join(F.slice(F.split(text, " "), 1, words), " ")
