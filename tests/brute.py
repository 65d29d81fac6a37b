"""Step-by-step evaluation of the two semantics, for small inputs; shares nothing with the package.

Updates are (key, attribute, start, end, op, seq), reads (key, attribute, start, end, value).
"""

from collections import defaultdict

INITIAL = {"ACCEPTFRND": 10, "PENDFRND": 0}


def _by_item(updates):
    items = defaultdict(list)
    for key, attribute, start, end, op, seq in updates:
        items[key, attribute].append((start, end, seq, op))
    return {item: sorted(rows) for item, rows in items.items()}


def running_states(updates):
    """item -> ordered [(start, end, value)], all updates."""
    states = {}
    for item, rows in _by_item(updates).items():
        value, steps = INITIAL.get(item[1], 0), []
        for start, end, _, op in rows:
            value += {"I": 1, "D": -1}.get(op, 0)
            steps.append((start, end, value))
        states[item] = steps
    return states


def running_values(read, states, own=True, rules=True):
    key, attribute, low, high, *_ = read
    initial = INITIAL.get(attribute, 0)
    steps = states.get((key, attribute))
    if not steps:
        return {initial}
    stored = {(s, e): v for s, e, v in steps}

    def at(a, b):
        return {v for (s, e), v in stored.items() if s <= b and a <= e}

    values = at(low, high) if own else set()
    if rules and low <= min(s for s, e in stored):
        values.add(initial)
    top = max(stored, key=lambda i: (i[1], i[0]))
    if rules and low > top[1]:
        values |= at(*top)
    closest = None
    for s, e, _ in steps:
        if e > low:
            break
        closest = (s, e)
    return values | (at(*closest) if closest else {initial})


def possible_states(updates):
    """item -> {(start, end): set of values}."""
    states = {}
    matched = []
    for key, attribute, *rest in updates:
        matched += [(key, name, *rest) for name in INITIAL if name in attribute]
    for item, rows in _by_item(matched).items():
        ops = defaultdict(set)
        for start, end, _, op in rows:
            ops[start, end].add(op == "I")
        values, states[item] = {INITIAL[item[1]]}, {}
        for interval in sorted(ops):
            values = {v + 1 if up else max(v - 1, 0) for v in values for up in ops[interval]}
            states[item][interval] = values
    return states


def possible_values(read, states, own=True):
    key, attribute, low, high, *_ = read
    state = states.get((key, attribute), {})

    def at(a, b):
        return set().union(*(v for (s, e), v in state.items() if a < b and s < b and a < e))

    values = at(low, high) if own else set()
    ended = [(s, e) for s, e in state if 1 < e < low]
    if not ended:
        return values | {INITIAL[attribute]}
    last = max(e for s, e in ended)
    for s, e in ended:
        if e == last:
            values |= at(s, e)
    return values
