"""Best selections under a cap, exactly, one group (a slate's pool) at a time."""

from __future__ import annotations

import dataclasses
import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def best_pick(value: np.ndarray, cost: np.ndarray, picks: int, cap: int, locked: frozenset[int] = frozenset()) -> tuple[float, list[int]] | None:
    """(value, places) of the best `picks` items with total cost up to `cap`, with all locked ones; None if none fits.

    Dynamic programming over (items, picks, cost); ties go to the items that come first.
    """
    base = sum(int(cost[i]) for i in locked)
    k, room = picks - len(locked), cap - base
    free = [i for i in range(len(value)) if i not in locked and np.isfinite(value[i])]
    if k < 0 or room < 0 or len(free) < k:
        return None
    best = np.full((k + 1, room + 1), -np.inf)
    best[0] = 0.0
    taken = np.zeros((len(free), k + 1, room + 1), bool)
    for n, i in enumerate(free):
        c = int(cost[i])
        if c > room:
            continue
        for j in range(k, 0, -1):
            tried = np.full(room + 1, -np.inf)
            tried[c:] = best[j - 1, : room + 1 - c] + value[i]
            better = tried > best[j]
            taken[n, j] = better
            best[j][better] = tried[better]
    if not np.isfinite(best[k, room]):
        return None
    out, j, r = list(locked), k, room
    for n in range(len(free) - 1, -1, -1):
        if j and taken[n, j, r]:
            out.append(free[n])
            j, r = j - 1, r - int(cost[free[n]])
    return float(best[k, room] + sum(value[i] for i in locked)), sorted(out)


def best_led_pick(value: np.ndarray, cost: np.ndarray, lead_value: np.ndarray, lead_cost: np.ndarray, picks: int, cap: int, locked: frozenset[int] = frozenset()) -> tuple[float, list[int], int] | None:
    """(value, places, place of the lead) like best_pick, one of the picks being the lead, with its own value and cost.

    One pass over the items for all leads: the states are (lead given or not, picks, cost).
    """
    items = [i for i in range(len(value)) if np.isfinite(value[i])]
    if picks < 1 or cap < 0 or not locked <= set(items):
        return None
    best = np.full((2, picks + 1, cap + 1), -np.inf)
    best[0, 0] = 0.0
    taken = np.zeros((len(items), 2, picks + 1, cap + 1), np.int8)  # 1: picked, 2: picked as the lead
    for n, i in enumerate(items):
        for j in range(picks, 0, -1):
            for led in (1, 0):
                ways = [(1, led, int(cost[i]), value[i])] + [(2, 0, int(lead_cost[i]), lead_value[i])] * led
                new = np.full(cap + 1, -np.inf) if i in locked else best[led, j].copy()
                for how, before, c, v in ways:
                    if c <= cap:
                        tried = best[before, j - 1, : cap + 1 - c] + v
                        better = tried > new[c:]
                        new[c:][better] = tried[better]
                        taken[n, led, j, c:][better] = how
                best[led, j] = new
        if i in locked:
            best[:, 0] = -np.inf
    if not np.isfinite(best[1, picks, cap]):
        return None
    out, boss, led, j, r = [], -1, 1, picks, cap
    for n in range(len(items) - 1, -1, -1):
        how, i = taken[n, led, j, r], items[n]
        if how:
            out.append(i)
            j, r = j - 1, r - int(lead_cost[i] if how == 2 else cost[i])
            if how == 2:
                boss, led = i, 0
    return float(best[1, picks, cap]), sorted(out), boss


def whole_units(cost: np.ndarray, unit: float) -> np.ndarray:
    """Costs as counts of `unit`; a cost that is no multiple of it is an error, as rounding would change what fits."""
    units = np.round(cost / unit)
    if (np.abs(units * unit - cost) > 1e-6).any():
        raise ValueError(f"costs are no multiples of {unit}: {cost[np.abs(units * unit - cost) > 1e-6][:3]}")
    return units.astype(int)


def best_selections(df: DataFrame, group: str, item: str, value: str, cost: str, picks: int, cap: float, unit: float, lead: float = 1.0, locked: str | None = None) -> DataFrame:
    """(group, item, is_lead, total): the best selection of each group; with lead > 1 one item counts and costs that many times.

    Costs (the lead's too) must be whole `unit`s, else it fails; rows with a NULL value, cost or item are not eligible;
    locked names a boolean column of items that must stay. A group is a pool of bounded size; groups are spread over tasks.
    """

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[item, value, cost]).sort_values([value, item], ascending=[False, True]).drop_duplicates(item).reset_index(drop=True)
        v, price = pdf[value].to_numpy(float), pdf[cost].to_numpy(float)
        c, room = whole_units(price, unit), int(cap // unit)
        fixed = frozenset(np.flatnonzero(pdf[locked].to_numpy(bool))) if locked else frozenset()
        found = best_pick(v, c, picks, room, fixed) if lead == 1.0 else best_led_pick(v, c, lead * v, whole_units(lead * price, unit), picks, room, fixed)
        if not found:
            return pd.DataFrame({"group": [], "item": [], "is_lead": [], "total": []}).astype({"group": str, "item": str, "is_lead": bool, "total": float})
        total, places, boss = found if lead != 1.0 else (*found, None)
        return pd.DataFrame({"group": str(key[0]), "item": pdf[item].iloc[places].astype(str).to_numpy(), "is_lead": [i == boss for i in places], "total": total})

    return df.groupBy(group).applyInPandas(solve, "group string, item string, is_lead boolean, total double")


@dataclasses.dataclass(frozen=True)
class Rules:
    """What a selection must keep to.

    slots: the kinds that may fill each slot. cap: most total cost, in whole units. per_team: most items of one team.
    leader, followers, same, opposed: an item of kind `leader` needs `same` items of the kinds `followers` of its own
    team and `opposed` ones of its opponent's. lead: factor of value and cost of one item that leads (1: none).
    overlap: most items in common with each earlier selection. share: most selections of all that may have one item.
    """

    slots: tuple[frozenset[str], ...]
    cap: int
    per_team: int = 99
    leader: str = ""
    followers: frozenset[str] = frozenset()
    same: int = 0
    opposed: int = 0
    lead: float = 1.0
    overlap: int | None = None
    share: float = 1.0

    def counts(self) -> list[dict[str, int]]:
        """How many items of each kind a selection may have: a pattern for each way to fill the slots."""
        found = {tuple(sorted(p)) for p in itertools.product(*[sorted(s) for s in self.slots])}
        return [dict(Counter(p)) for p in sorted(found)]


def _suffix_tops(score: np.ndarray, k: int) -> list[list[float]]:
    """out[n][j]: sum of the j greatest scores from place n on (minus infinity where there are fewer)."""
    out = [[0.0] + [-np.inf] * k]
    top: list[float] = []
    for x in score[::-1].tolist():
        top = sorted([*top, x], reverse=True)[:k]
        sums = np.cumsum(top).tolist()
        out.append([0.0, *sums] + [-np.inf] * (k - len(sums)))
    return out[::-1]


def _cores(rules: Rules, pattern: dict[str, int], order: dict[str, list[int]], team, opponent) -> list[frozenset[int]]:
    """A leader with the followers it needs, in every way; one empty core where there is no such rule, or several leaders."""
    if pattern.get(rules.leader) != 1 or not rules.same + rules.opposed:
        return [frozenset()]
    follow = [i for k in order if k in rules.followers for i in order[k]]
    out = []
    for x in order[rules.leader]:
        own, other = [i for i in follow if team[i] == team[x] and i != x], [i for i in follow if team[i] == opponent[x] and i != x]
        out += [frozenset([x, *s, *o]) for s in itertools.combinations(own, rules.same) for o in itertools.combinations(other, rules.opposed)]
    return list(dict.fromkeys(out))


def best_sets(value, cost, kind, team, opponent, rules: Rules, locked=frozenset(), banned=frozenset(), prior=(), ties: bool = False) -> list[tuple[float, tuple[int, ...], int]]:
    """[(total, places, place of the lead or -1)]: the best selections under the rules, exactly; with `ties` all of them.

    For each pattern of counts, each lead and each leader with its followers, these and the locked items are taken, and
    the rest is searched depth first, one kind after the other. A branch is left when its value and the best of what is
    still to come, at a price per unit of cost, stay below the best total so far. The price is the one with the least
    such bound at the start. Items come in the order of value less price, so good selections are found early; without
    ties the first best one holds.
    """
    free = [i for i in range(len(value)) if np.isfinite(value[i]) and i not in banned]
    if not set(locked) <= set(free):
        return []
    best, found = -np.inf, {}
    leads = sorted(free, key=lambda i: (-value[i], i)) if rules.lead != 1.0 else [-1]
    limit = len(rules.slots) if rules.overlap is None else rules.overlap

    def allowed(picked) -> bool:
        """Whether a whole selection keeps to the rules on teams, leaders and earlier selections."""
        if max(Counter(team[i] for i in picked).values(), default=0) > rules.per_team or any(len(p & set(picked)) > limit for p in prior):
            return False
        follow = [y for y in picked if kind[y] in rules.followers]
        return all(kind[x] != rules.leader or sum(team[y] == team[x] for y in follow if y != x) >= rules.same and sum(team[y] == opponent[x] for y in follow if y != x) >= rules.opposed for x in picked)

    def search(pattern, v, c, lead: int, forced: frozenset[int], order, price: float) -> None:
        nonlocal best, found
        left = {k: pattern[k] - sum(kind[i] == k for i in forced) for k in pattern}
        if any(kind[i] not in pattern for i in forced) or min(left.values()) < 0:
            return
        kinds = [k for k in sorted(left) if left[k]]
        lists = {k: [i for i in order[k] if i not in forced] for k in kinds}
        if any(len(lists[k]) < left[k] for k in kinds):
            return
        tops = {k: _suffix_tops(np.array([v[i] - price * c[i] for i in lists[k]]), left[k]) for k in kinds}
        rest = [sum(tops[k][0][left[k]] for k in kinds[j + 1 :]) for j in range(len(kinds))]
        teams = Counter(team[i] for i in forced)
        picked, shared = list(forced), [len(p & forced) for p in prior]
        least = lambda: best - 1e-9 if ties else best + 1e-9

        def descend(j: int, at: int, need: int, total: float, room: int) -> None:
            nonlocal best, found
            while need == 0:
                j += 1
                if j >= len(kinds):
                    if total >= least() and allowed(picked):
                        if total > best + 1e-9:
                            best, found = total, {}
                        found[tuple(sorted(picked)), lead] = total
                    return
                at, need = 0, left[kinds[j]]
            items, top = lists[kinds[j]], tops[kinds[j]]
            for a in range(at, len(items) - need + 1):
                if total + price * room + top[a][need] + rest[j] < least():
                    return
                i = items[a]
                if c[i] > room or teams[team[i]] >= rules.per_team or any(i in p and shared[q] >= limit for q, p in enumerate(prior)):
                    continue
                picked.append(i)
                teams[team[i]] += 1
                for q, p in enumerate(prior):
                    shared[q] += i in p
                descend(j, a + 1, need - 1, total + v[i], room - c[i])
                picked.pop()
                teams[team[i]] -= 1
                for q, p in enumerate(prior):
                    shared[q] -= i in p

        room = rules.cap - sum(c[i] for i in forced)
        total = sum(v[i] for i in forced)
        if room >= 0 and total + price * room + sum(tops[k][0][left[k]] for k in kinds) >= least():
            descend(-1, 0, 0, total, room)

    for pattern in rules.counts():
        order = {k: [i for i in free if kind[i] == k] for k in pattern}
        if any(len(order[k]) < pattern[k] for k in pattern):
            continue
        low = max(1, min((int(cost[i]) for i in free), default=1))
        prices = np.linspace(0, 2 * max((abs(value[i]) for i in free), default=1.0) / low, 80).tolist()
        at = lambda r: r * rules.cap + sum(sum(sorted((value[i] - r * cost[i] for i in order[k]), reverse=True)[: pattern[k]]) for k in pattern)  # noqa: E731, B023
        price = min(prices, key=at)
        for k in order:
            order[k].sort(key=lambda i: (price * cost[i] - value[i], i))
        cores = _cores(rules, pattern, order, team, opponent)
        cores.sort(key=lambda x: (sum(price * cost[i] - value[i] for i in x), sorted(x)))
        for lead in leads:
            v = [rules.lead * x if i == lead else x for i, x in enumerate(value)]
            c = [int(round(rules.lead * x)) if i == lead else int(x) for i, x in enumerate(cost)]
            for core in cores:
                search(pattern, v, c, lead, core | set(locked) | ({lead} if lead >= 0 else set()), order, price)
    out = [(total, places, lead) for (places, lead), total in found.items()]
    return sorted(out, key=lambda f: (f[1], f[2])) if ties else out[:1]


def portfolio(value, cost, kind, team, opponent, rules: Rules, n: int, locked=frozenset(), ties: bool = False) -> list[tuple[float, tuple[int, ...], int]]:
    """`n` selections in turn, each the best that keeps its distance from those before; fewer where none is left.

    An item that is in floor(n * share) selections (one at least) is in no further one. A later selection is never equal
    to an earlier one. With `ties` and n = 1, all best selections.
    """
    if n == 1:
        return best_sets(value, cost, kind, team, opponent, rules, locked, ties=ties)
    most, used, out = max(1, int(n * rules.share + 1e-12)), Counter(), []
    each = dataclasses.replace(rules, overlap=min(len(rules.slots) - 1, len(rules.slots) if rules.overlap is None else rules.overlap))
    for _ in range(n):
        banned = {i for i, k in used.items() if k >= most and i not in locked}
        found = best_sets(value, cost, kind, team, opponent, each, locked, banned, [set(s) for _, s, _ in out])
        if not found:
            break
        out.append(found[0])
        used.update(found[0][1])
    return out


def constrained_selections(df: DataFrame, group: str, item: str, value: str, cost: str, kind: str, team: str, opponent: str, rules: Rules, unit: float, n: int = 1, locked: str | None = None, ties: bool = False) -> DataFrame:
    """(group, number, item, is_lead, total): selections of each group under the rules; see `portfolio`.

    Costs must be whole `unit`s (the lead's too). Rows with a NULL item, value, cost or kind are not eligible, of an
    item that is there twice the row with the greatest value counts. A group is a pool of bounded size (one slate);
    groups are spread over tasks.
    """

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[item, value, cost, kind]).sort_values([value, item], ascending=[False, True]).drop_duplicates(item).reset_index(drop=True)
        price = pdf[cost].to_numpy(float)
        whole_units(rules.lead * price, unit)
        fixed = frozenset(np.flatnonzero(pdf[locked].to_numpy(bool)).tolist()) if locked else frozenset()
        found = portfolio(pdf[value].to_numpy(float).tolist(), whole_units(price, unit).tolist(), pdf[kind].tolist(), pdf[team].tolist(), pdf[opponent].tolist(), rules, n, fixed, ties)
        rows = [(str(key[0]), k, str(pdf[item].iloc[i]), i == lead, total) for k, (total, places, lead) in enumerate(found, 1) for i in places]
        return pd.DataFrame(rows, columns=["group", "number", "item", "is_lead", "total"])

    return df.groupBy(group).applyInPandas(solve, "group string, number int, item string, is_lead boolean, total double")
