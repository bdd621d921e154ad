"""Small hand-made counts and memberships."""

COUNTS = (
    "season_start int, round string, location string, taxon string, "
    "taxon_group string, taxon_group_code string, individuals bigint"
)
MEMBERS = (
    "area_code string, area_name string, location string, valid_from date, valid_to date"
)
ROUNDS = ("Oktober", "November", "December", "Januari", "Februari", "Maart")


def counts(spark, rows):
    """Rows of (season, round, location, individuals[, taxon[, group[, group code]]])."""
    full = []
    for season, rnd, location, individuals, *rest in rows:
        taxon, group, code = (*rest, *("duck", "ducks", "D")[len(rest):])
        full.append((season, rnd, location, taxon, group, code, individuals))
    return spark.createDataFrame(full, COUNTS)


def members(spark, pairs):
    """Rows of (area code, location[, area name])."""
    return spark.createDataFrame(
        [(code, (name or [code])[0], location, None, None) for code, location, *name in pairs],
        MEMBERS,
    )


def as_dict(df, key, value):
    key = [key] if isinstance(key, str) else key
    return {
        tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r[value] for r in df.collect()
    }
