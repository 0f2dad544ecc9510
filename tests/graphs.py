"""Small graphs, and the operators once more as plain Python to compare with."""

import random

from waxgraph import fixed, schemas

TYPES = list(fixed.EDGE_TYPES)


def node(kind, id_, text=None, **more):
    row = dict.fromkeys(schemas.NODES.names)
    row.update(space=fixed.SPACE_OF_KIND[kind], kind=kind, id=str(id_), id_num=int(id_), **more)
    row["title" if kind == "Release" else "name"] = text
    return tuple(row[name] for name in schemas.NODES.names)


def edge(type_, src, dst, ordinal=0):
    src_space, dst_space = fixed.EDGE_SPACES[type_]
    return (type_, src_space, str(src), dst_space, str(dst), ordinal)


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(edges, schemas.EDGES)


def random_graph(seed, artists=14, groups=8, releases=20, labels=6):
    """Edges of all types, with parallel ones, loops and a hub."""
    rnd = random.Random(seed)
    people, bands = range(1, artists + 1), range(101, 101 + groups)
    records, houses = range(1, releases + 1), range(1, labels + 1)
    nodes = [node("Artist", i, f"Artist {i}") for i in people] + [node("Group", i, f"Group {i}") for i in bands]
    nodes += [node("Release", i, f"Release {i}") for i in records] + [node("Label", i, f"Label {i}") for i in houses]
    edges = {edge("MEMBER_OF", rnd.choice(people), rnd.choice(bands)) for _ in range(15)}
    edges |= {edge("SUBLABEL", rnd.choice(houses), rnd.choice(houses)) for _ in range(5)}
    edges |= {edge("ALIAS_OF", *sorted(rnd.choices(people, k=2))) for _ in range(9)}
    edges |= {edge("RELEASED_ON", rnd.choice(records), rnd.choice(houses), rnd.randint(0, 1)) for _ in range(30)}
    edges |= {edge("CREDITED", rnd.choice(people), rnd.choice(records), rnd.randint(0, 2)) for _ in range(50)}
    edges |= {edge("CREDITED", 1, record) for record in records}
    return nodes, sorted(edges)


def adjacency(edges):
    near = {}
    for e in edges:
        start, end = (e[1], e[2]), (e[3], e[4])
        near.setdefault(start, []).append((e, end))
        if start != end:
            near.setdefault(end, []).append((e, start))
    for found in near.values():
        found.sort(key=lambda x: (TYPES.index(x[0][0]), int(x[0][2]), int(x[0][4]), x[0][5]))
    return near


def one_hop(near, ids, limit):
    """Budget spent type by type, as ordered maps of nodes and edges."""
    nodes, edges = {}, {}
    for id_ in ids:
        nodes.setdefault(id_)
        left = limit
        for type_ in TYPES:
            batch = [x for x in near.get(id_, []) if x[0][0] == type_][:left]
            left -= len(batch)
            for e, other in batch:
                nodes.setdefault(other)
                edges.setdefault(e)
    return list(nodes), list(edges)


def two_hops(edges, ids, limit, cap):
    """(node, degree, expanded) in order, and edges, of one request."""
    near = adjacency(edges)
    nodes1, edges1 = one_hop(near, ids, limit)
    nodes2, edges2 = one_hop(near, nodes1, limit)
    nodes = list(dict.fromkeys(nodes1 + nodes2))
    found = list(dict.fromkeys(edges1 + edges2))
    degree = dict.fromkeys(nodes, 0)
    for e in found:
        degree[e[1], e[2]] += 1
        degree[e[3], e[4]] += 1
    kept = nodes[:cap]
    shown = [e for e in found if (e[1], e[2]) in kept and (e[3], e[4]) in kept]
    return [(n, degree[n], n in nodes1) for n in kept], shown
