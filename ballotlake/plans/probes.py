"""The arguments the registered queries are asked with."""

POLL = 10
DURING = 1705449600  # while poll 10 is open
AFTER = 1705622400  # after poll 10 has ended
LOCKS_FROM = 1704500000
VOTER = "u5"
LAST_VOTER, LAST_POLL = "u13", 12  # who voted in that poll, at every scale
VOTERS = ("u5", "u10", "u33", "u60")
CALLERS = ("u5", "u3", "u11")
HASH_LIKE = r"NATION\_1%"
