"""The composed aggregation step (C5, C1, E1, E2, E3) against a sequential model
of the source's row loop on randomized data."""

import random

from wayfarer.functions.similarity import lcs_len
from wayfarer.plans.rebuild import aggregate_places
from wayfarer.schemas import PLACEHOLDER_PHRASES


def key(s):
    s = "".join(ch for ch in s.lower() if not (128 <= ord(ch) <= 255))
    s = "".join(ch if ch.isalnum() else " " for ch in s)
    return " ".join(sorted(s.split()))


def name_match(a, b):
    a, b = key(a), key(b)
    return bool(a) and bool(b) and 400 * lcs_len(a, b) > 181 * (len(a) + len(b))


def desc_match(a, b):
    a, b = a.lower(), b.lower()
    return 400 * lcs_len(a, b) >= 171 * (len(a) + len(b))


def sequential(rows):
    data = {}
    for seq, country, place, desc, region, ptype, url, blog in rows:
        place = (place or "nan").strip()
        desc = (desc or "nan").strip()
        if not place or place.lower() == "nan" or not desc or desc.lower() == "nan":
            continue
        low = desc.lower()
        if any(p in low for p in PLACEHOLDER_PHRASES):
            continue
        bucket = data.setdefault(country, {})
        target = next((x for x in bucket if name_match(place, x)), place)
        obj = bucket.setdefault(target, {"d": [], "google_maps_url": "", "region": "", "place_type": "", "blog_source": ""})
        if not any(desc_match(desc, x) for x in obj["d"]):
            obj["d"].append(desc)
        for k, v in (("google_maps_url", url), ("region", region), ("place_type", ptype), ("blog_source", blog)):
            if not obj[k] and v is not None and v.strip():
                obj[k] = v.strip()
    out = set()
    for c, places in data.items():
        for p, o in places.items():
            for d in o["d"]:
                out.add((c, p, d, o["region"], o["place_type"], o["google_maps_url"], o["blog_source"]))
    return out


def _data(seed, n):
    rng = random.Random(seed)
    names = ["Wat Arun", "Grand Palace", "Night Market", "Sunset Beach", "Old Town"]
    texts = ["Lovely at dawn with quiet courtyards.", "Busy but worth it for the food stalls.", "Great views over the river at night."]
    rows = []
    for i in range(n):
        nm = list(rng.choice(names))
        if rng.random() < 0.5:
            nm.insert(rng.randrange(len(nm) + 1), rng.choice("aeiou"))
        nm = "".join(nm)
        if rng.random() < 0.1:
            nm = " ".join(reversed(nm.split()))
        d = list(rng.choice(texts))
        for _ in range(rng.randint(0, 8)):
            d[rng.randrange(len(d))] = rng.choice("xyz")
        d = "".join(d)
        r = rng.random()
        if r < 0.05:
            d = "Sorry, not mentioned in this text."
        elif r < 0.08:
            d = "  "
        elif r < 0.1:
            nm = "nan"
        meta = lambda v: rng.choice([None, "", "  ", v])
        rows.append((i, rng.choice(["TH", "LA"]), nm, d, meta(f"R{i % 3}"), meta("Temple"), meta(f"https://m/{i}"), meta("blog")))
    return rows


def test_aggregate_places_equals_sequential_loop(spark):
    rows = _data(11, 250)
    df = spark.createDataFrame(
        rows, "seq long, country string, place string, description string, region string, place_type string, google_maps_url string, blog_source string"
    )
    got = {
        (r.country, r.place, r.description, r.region, r.place_type, r.google_maps_url, r.blog_source)
        for r in aggregate_places(df, ["seq"]).collect()
    }
    assert got == sequential(rows)


def test_update_catalog_from_folder(spark, tmp_dir):
    import os

    from pyspark.sql import functions as F

    from wayfarer.operators.summary import place_summary
    from wayfarer.plans.rebuild import update_catalog_from_folder
    from wayfarer.schemas import CATEGORIES
    from wayfarer.session import shared_path
    from wayfarer.sources.csv import read_catalog, write_catalog

    base_rows = [(1, "TH", "Wat Arun", "old text", *[6.0] * 10), (2, "LA", "Pha That", "x", *[2.0] * 10)]
    ddl = "seq long, country string, place string, description string, " + ", ".join(f"{c} double" for c in CATEGORIES)
    base = place_summary(spark.createDataFrame(base_rows, ddl), ["seq"], as_of="2024-01-01")
    base = base.withColumns({c: F.col(c).cast("double") for c in CATEGORIES})
    cat = shared_path(spark, "cat")
    write_catalog(base, cat)
    os.makedirs(f"{tmp_dir}/drop")
    hdr = "country,place,text," + ",".join(CATEGORIES) + "\n"
    with open(f"{tmp_dir}/drop/new.csv", "w") as f:
        f.write(hdr + "TH,Wat Arun,new review," + ",".join(["8"] * 10) + "\n")
        f.write("TH,Fresh,nice place," + ",".join(["3"] * 10) + "\n")
    ledger = shared_path(spark, "ledger")
    stats = update_catalog_from_folder(spark, f"file://{tmp_dir}/drop", cat, ledger, as_of="2024-02-02")
    assert sorted(map(tuple, stats.collect())) == [("TH", "merged", 1), ("TH", "new", 1)]
    got = {(r.country, r.place): r for r in read_catalog(spark, cat).collect()}
    assert got[("TH", "Wat Arun")].romance == 7.0 and got[("TH", "Wat Arun")].description_count == 2
    assert got[("TH", "Fresh")].description_count == 1
    assert got[("LA", "Pha That")].romance == 2.0  # untouched country kept as it was
    # the same file is not merged twice
    assert update_catalog_from_folder(spark, f"file://{tmp_dir}/drop", cat, ledger) is None
