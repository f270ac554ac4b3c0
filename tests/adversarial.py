"""An adversarial portfolio: hot keys, duplicates, NULLs, zero and negative money.

One client and one agent hold a third of all policies; one policy holds a
third of all premiums and of all claims (so the SQL-track fan-out for that
policy alone is millions of joined rows in a brute-force evaluation);
dimension tables carry duplicate and missing keys; statuses include a
lower-case variant and NULL.  Built with numpy from a fixed seed.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pyarrow as pa

from lossgrid.sources.schemas import PRODUCTS

# Fixed values; note the typographic apostrophe U+2019.
COUNTRIES = ("Côte d’Ivoire", "Kenya", "Maroc", "Nigeria", "Sénégal")

MONEY = pa.decimal128(10, 2)


def _money(cents: int | None) -> Decimal | None:
    return None if cents is None else Decimal(int(cents)).scaleb(-2)


def _maybe(rng, value, p_null: float):
    return None if rng.random() < p_null else value


def _date(rng, lo=dt.date(2019, 1, 1), span=7 * 365):
    return lo + dt.timedelta(days=int(rng.integers(0, span)))


def build(seed: int = 11, n_policies: int = 3000) -> dict[str, pa.Table]:
    rng = np.random.default_rng(seed)
    regions = list(COUNTRIES) + [None]

    agents = [(a, regions[int(rng.integers(0, len(regions)))], int(rng.integers(1, 15))) for a in range(60)]
    agents += [(None, "Sénégal", 4)]  # met by policies without an agent in the master only
    agents += [agents[5], (6, "Maroc", 3)]  # an exact duplicate and a conflicting one

    clients = [
        (c, _maybe(rng, int(rng.integers(18, 80)), 0.02), regions[int(rng.integers(0, len(regions)))],
         _maybe(rng, _date(rng, dt.date(2015, 1, 1)), 0.02))
        for c in range(1, 401)
    ]
    clients += [clients[3], (8, 44, "Kenya", dt.date(2018, 5, 1)), (None, 50, "Togo", dt.date(2019, 2, 1))]

    policies = []
    for pid in range(1, n_policies + 1):
        client = 1 if pid % 3 == 0 else int(rng.integers(1, 420))
        agent = 2 if pid % 3 == 1 else int(rng.integers(0, 70))
        start = _maybe(rng, _date(rng), 0.01)
        end = None if start is None else _maybe(rng, start + dt.timedelta(days=int(rng.integers(-300, 600))), 0.01)
        policies.append((
            pid,
            _maybe(rng, client, 0.02),
            "Voyage" if pid % 97 == 0 else _maybe(rng, PRODUCTS[int(rng.integers(0, len(PRODUCTS)))], 0.01),
            start,
            end,
            _maybe(rng, agent, 0.02),
        ))
    policies += [policies[min(9, len(policies) - 1)], (11, 5, "Vie", dt.date(2021, 1, 1), dt.date(2022, 1, 1), 3)]

    def amount():
        u = rng.random()
        if u < 0.01:
            return None
        if u < 0.03:
            return _money(0)
        if u < 0.04:
            return _money(-int(rng.integers(1, 50_000)))
        return _money(int(rng.integers(1, 300_000)))

    premiums = []
    for i in range(3 * n_policies):
        pid = 1 if i % 3 == 0 else int(rng.integers(1, n_policies + 50))
        premiums.append((i, _maybe(rng, pid, 0.01), amount(), _maybe(rng, _date(rng), 0.02)))

    statuses = ["Accepted"] * 14 + ["Rejected"] * 4 + ["accepted", None]
    claims = []
    for i in range(3 * n_policies):
        pid = 1 if i % 3 == 0 else int(rng.integers(1, n_policies + 50))
        claims.append((
            _maybe(rng, i, 0.01),
            _maybe(rng, pid, 0.01),
            amount(),
            _maybe(rng, _date(rng), 0.02),
            statuses[int(rng.integers(0, len(statuses)))],
        ))

    # Agents whose loss ratio sits exactly on an alert bound that double
    # arithmetic overshoots: 0.27 / 0.09 -> 300 %, 2.35 / 0.47 -> 500 %.
    boundary = {90: ([3, 3, 3], [9, 9, 9]), 91: ([15, 16, 16], [78, 78, 79])}
    for agent, (prem_cents, claim_cents) in boundary.items():
        agents.append((agent, "Kenya", 4))
        for j, (pc, cc) in enumerate(zip(prem_cents, claim_cents)):
            pid = 9000 + agent * 10 + j
            policies.append((pid, 1, "Auto", dt.date(2021, 1, 1), dt.date(2022, 1, 1), agent))
            premiums.append((90000 + pid, pid, _money(pc), dt.date(2021, 2, 1)))
            claims.append((90000 + pid, pid, _money(cc), dt.date(2021, 3, 1), "Accepted"))

    schemas = {
        "agents": pa.schema([("agent_id", pa.int32()), ("region", pa.string()), ("experience_years", pa.int32())]),
        "clients": pa.schema([("client_id", pa.int32()), ("age", pa.int32()), ("country", pa.string()),
                              ("signup_date", pa.date32())]),
        "policies": pa.schema([("policy_id", pa.int32()), ("client_id", pa.int32()), ("product_type", pa.string()),
                               ("start_date", pa.date32()), ("end_date", pa.date32()), ("agent_id", pa.int32())]),
        "premiums": pa.schema([("premium_id", pa.int32()), ("policy_id", pa.int32()), ("amount", MONEY),
                               ("payment_date", pa.date32())]),
        "claims": pa.schema([("claim_id", pa.int32()), ("policy_id", pa.int32()), ("claim_amount", MONEY),
                             ("claim_date", pa.date32()), ("status", pa.string())]),
    }
    rows = {"agents": agents, "clients": clients, "policies": policies, "premiums": premiums, "claims": claims}
    return {
        name: pa.Table.from_pylist([dict(zip(schemas[name].names, r)) for r in rows[name]], schema=schemas[name])
        for name in schemas
    }
