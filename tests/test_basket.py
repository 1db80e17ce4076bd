import itertools
import random

import pytest

from shelfwise.plans import basket


def brute_force(lines, category, length, unordered, k=10):
    orders = {}
    for order, product in lines:
        if category.get(product) is not None and order is not None:
            orders.setdefault(order, set()).add(product)
    counts = {}
    for products in orders.values():
        found = set()
        for combo in itertools.combinations(sorted(products), length):
            names = tuple(category[p] for p in combo)
            if len(set(names)) == length:
                found.add(tuple(sorted(names)) if unordered else names)
        for names in found:
            counts[names] = counts.get(names, 0) + 1
    return [(*names, n) for names, n in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]]


@pytest.mark.parametrize("unordered", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(make, spark, seed, unordered):
    """Random orders with many products per category, one of them holding a third of all lines."""
    rng = random.Random(seed)
    category = {p: rng.choice(["A", "B", "C", "D", "E", None]) for p in range(1, 41)}
    lines = [(order, rng.randint(1, 44)) for order in range(60) for _ in range(rng.randint(1, 9))]
    lines += [(1000, rng.randint(1, 44)) for _ in range(150)] + [(None, 3), (None, 4)]
    orders = make.lines(*[{"order": o, "prod": p} for o, p in lines])
    products = make.table("products", list(category.items()))
    for length, query in ((2, basket.category_pairs), (3, basket.category_triples)):
        for k in (10, 1000):
            got = [tuple(r) for r in query(orders, products, k, unordered).collect()]
            assert got == brute_force(lines, category, length, unordered, k)


def test_inner_products_decide_a_triple(make):
    """B's first product precedes A and its last follows C: only the middle one makes (A, B, C)."""
    products = make.table("products", [(1, "B"), (2, "A"), (3, "B"), (4, "C"), (5, "B")])
    orders = make.lines(*[{"order": 1, "prod": p} for p in range(1, 6)])
    got = {tuple(r) for r in basket.category_triples(orders, products, 100).collect()}
    assert ("A", "B", "C", 1) in got and ("C", "A", "B", 1) not in got


def test_single_product_baskets_give_nothing(make):
    products = make.table("products", [(1, "A"), (2, "A")])
    orders = make.lines({"order": 1, "prod": 1}, {"order": 2, "prod": 1}, {"order": 2, "prod": 2})
    assert basket.category_pairs(orders, products).count() == 0
    assert basket.category_triples(orders, products).count() == 0
