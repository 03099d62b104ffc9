"""Small content trees to test with."""

from canopy.schema import NODES, PROPERTIES


def nodes(spark, paths):
    """Of ``{path: primary type}``."""
    rows = []
    for path, kind in paths.items():
        names = [s for s in path.split("/") if s]
        parent = None if not names else "/" + "/".join(names[:-1])
        rows.append((path, parent, names[-1] if names else "", len(names), kind))
    return spark.createDataFrame(rows, NODES)


def prop(path, name, kind, values, multiple=False):
    column = {"Long": 1, "Double": 2, "Boolean": 3, "Binary": 4, "External": 5}.get(kind, 0)
    kind = "Binary" if kind == "External" else kind
    if multiple and not values:
        return [(path, name, kind, True, None, None, None, None, None, None, None)]
    out = []
    for k, v in enumerate(values if multiple else [values]):
        cells = [None] * 6
        cells[column] = v
        out.append((path, name, kind, multiple, k, *cells))
    return out


def properties(spark, *lists):
    return spark.createDataFrame([r for x in lists for r in x], PROPERTIES)


def every_shape(spark):
    """A node with a value of every shape."""
    n = nodes(spark, {"/": None, "/content": "nt:unstructured", "/content/jcr:content": "nt:unstructured"})
    c = "/content"
    p = properties(
        spark, prop(c, "jcr:primaryType", "Name", "nt:unstructured"), prop(c, "title", "String", "Hello"), prop(c, "tags", "String", ["a", "b"], True), prop(c, "empty_tags", "String", [], True),
        prop(c, "count", "Long", 42), prop(c, "ratio", "Double", 2.5), prop(c, "flag", "Boolean", True), prop(c, "data", "Binary", 3), prop(c, "external", "External", "blob-1"),
        prop("/content/jcr:content", "jcr:primaryType", "Name", "nt:unstructured"),
    )
    return n, p


def two_revisions(spark):
    """A tree before and after a title, a child's property, a removal and an addition."""
    kept = {"/": None, "/content": "t", "/content/jcr:content": "t", "/content/kept": "t", "/content/kept/leaf": "t"}
    old_nodes = nodes(spark, kept | {"/content/subtree": "t", "/content/subtree/x": "t"})
    new_nodes = nodes(spark, kept | {"/content/added": "t", "/content/added/deep": "t", "/content/added/deep/x": "t"})
    c, j = "/content", "/content/jcr:content"
    common = [prop(c, "count", "Long", 42), prop(c, "data", "Binary", 3), prop(j, "ratio", "Double", 2.5), prop("/content/kept/leaf", "name", "String", "leaf")]
    old = properties(spark, prop(c, "title", "String", "Hello"), *common, prop("/content/subtree", "flag", "Boolean", True))
    new = properties(spark, prop(c, "title", "String", "Goodbye"), *common, prop(j, "extra", "String", "new"))
    return (old_nodes, old), (new_nodes, new)
