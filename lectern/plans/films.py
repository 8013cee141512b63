"""The film catalogue: one function for each step, composed lazily, written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import maps
from lectern.functions import text as T
from lectern.operators import filters, resolve, upsert

FILM = (
    "wikidata string, title map<string,string>, type array<string>, country array<string>, language array<string>, year int, "
    "imdb struct<id:string,title:string,originalTitle:string,type:string,year:int,endYear:int,runtime:int,genres:array<string>,seasons:bigint,episodes:bigint,rating:double,votes:int,lists:map<string,int>>, "
    "natively struct<language:string,level:int,temporaryLevel:boolean,url:string>, "
    "netflix struct<id:int,title:string,type:string,year:int,watchlist:boolean,countryDetails:map<string,struct<seasonDetails:string,newDate:string,expireDate:string,originalAudio:array<string>,audio:array<string>,subtitle:array<string>>>>, "
    "tmdb struct<id:int,kind:string>, origin array<string>"
)
ORDER = [c.strip().split(" ")[0] for c in ("wikidata x,title x,type x,country x,language x,year x,imdb x,tmdb x,natively x,netflix x,origin x").split(",")]


def import_watchlist(films: DataFrame, watched: DataFrame, force: bool = False) -> DataFrame:
    """Marks listed titles (id, title) as watched, the others not; with ``force`` unknown ones are added
    and titles refreshed."""
    w = watched.select(F.col("id").alias("__id"), F.col("title").alias("__title")).dropDuplicates(["__id"])
    met = films.join(w, F.col("netflix.id") == F.col("__id"), "full" if force else "left")
    hit = F.col("__id").isNotNull()
    n = F.col("netflix")
    kind = dict(films.dtypes)["netflix"]
    base = F.when(n.isNull() & hit, F.from_json(F.to_json(F.struct(F.col("__id").alias("id"))), kind)).otherwise(n)
    mark = F.when(hit, True).when(base["watchlist"], False).otherwise(base["watchlist"])
    out = base.withField("watchlist", mark)
    if force:
        out = out.withField("title", F.when(hit, F.coalesce(F.nullif("__title", F.lit("")), base["title"])).otherwise(base["title"]))
    return met.withColumns({"netflix": F.when(base.isNotNull(), out), "origin": F.when(hit, maps.add_members("origin", F.array(F.lit("netflix")))).otherwise(F.col("origin"))}).drop("__id", "__title")


def import_list(films: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """A ranked list (id, title, rank): members get their rank, former ones lose it, unknown ones are added."""
    m = members.select(F.col("id").alias("__id"), F.col("title").alias("__title"), F.col("rank").cast("int").alias("__rank")).dropDuplicates(["__id"])
    met = films.join(m, F.col("imdb.id") == F.col("__id"), "full")
    hit, i = F.col("__id").isNotNull(), F.col("imdb")
    base = F.when(i.isNull() & hit, F.from_json(F.to_json(F.struct(F.col("__id").alias("id"))), dict(films.dtypes)["imdb"])).otherwise(i)
    lists = F.when(hit, maps.put(base["lists"], F.lit(name), F.col("__rank"))).otherwise(F.map_filter(base["lists"], lambda k, _: k != name))
    lists = F.when(F.size(lists) > 0, lists)
    stale = ~hit & F.coalesce(F.map_contains_key(base["lists"], F.lit(name)), F.lit(False)) & lists.isNull()
    out = base.withField("lists", lists).withField("title", F.coalesce(F.nullif("__title", F.lit("")), base["title"]))
    origin = F.when(hit, maps.add_members("origin", F.array(F.lit("imdb")))).when(stale, maps.remove_members("origin", F.array(F.lit("imdb")))).otherwise(F.col("origin"))
    return met.withColumns({"imdb": F.when(base.isNotNull(), out), "origin": origin}).drop("__id", "__title", "__rank")


def import_catalogue(films: DataFrame, titles: DataFrame, countries: list[str], language: str = "ja") -> DataFrame:
    """Titles of a catalogue (id, title, type, year, countryDetails) whose original audio in one of the
    countries is in the language; details of other countries are kept."""
    t = titles.where(filters.original_audio(F.col("countryDetails"), countries, language)).select(*[F.col(c).alias(f"__{c}") for c in ("id", "title", "type", "year", "countryDetails")]).dropDuplicates(["__id"])
    met = films.join(t, F.col("netflix.id") == F.col("__id"), "full")
    hit, n = F.col("__id").isNotNull(), F.col("netflix")
    base = F.when(n.isNull() & hit, F.from_json(F.to_json(F.struct(F.col("__id").alias("id"))), dict(films.dtypes)["netflix"])).otherwise(n)
    scope = F.array(*[F.lit(c) for c in countries])
    out = base
    for c in ("title", "type", "year"):
        out = out.withField(c, F.when(hit, F.coalesce(f"__{c}", base[c])).otherwise(base[c]))
    out = out.withField("countryDetails", F.when(hit, maps.replace_scope(base["countryDetails"], F.col("__countryDetails"), scope)).otherwise(base["countryDetails"]))
    origin = F.when(hit, maps.add_members("origin", F.array(F.lit("netflix")))).otherwise(F.col("origin"))
    return met.withColumns({"netflix": F.when(base.isNotNull(), out), "origin": origin}).drop(*[f"__{c}" for c in ("id", "title", "type", "year", "countryDetails")])


def origins() -> dict[str, Column]:
    """Where a film can come from, and the id that it has there, as text."""
    return {"imdb": F.col("imdb.id"), "netflix": F.col("netflix.id").cast("string"), "tmdb": F.col("tmdb.id").cast("string")}


def resolve_entities(films: DataFrame, ids: DataFrame, owners: dict[str, Column] | None = None) -> DataFrame:
    """Films without entity get the one that all of their identifiers (kind, id, entity) agree on; ``owners``
    says which identifiers films have."""
    owners = owners or origins()
    keys = [f"__{kind}" for kind in owners]
    keyed = films.withColumns({f"__{kind}": c for kind, c in owners.items()})
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"__{kind}").alias("id")) for kind in owners])
    owned = keyed.where("wikidata is null").select(F.struct(*keys).alias("__ids"), F.explode(entries).alias("o")).select("__ids", "o.*").where("id is not null")
    found = resolve.agreed(owned.join(ids, ["kind", "id"]), "__ids", "entity", "__entity").select(*[F.col(f"__ids.{k}").alias(f"{k}_") for k in keys], "__entity")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    return keyed.join(found, same, "left").withColumn("wikidata", F.coalesce("wikidata", "__entity")).drop(*keys, *[f"{k}_" for k in keys], "__entity")


def merge_entities(films: DataFrame, order: str) -> DataFrame:
    """Films of one entity become one record, the first by ``order`` leading; films that own different ids
    of one kind stay apart."""
    named, rest = films.where("wikidata is not null"), films.where("wikidata is null")
    with_ids = named.withColumns({"__imdb": F.col("imdb.id"), "__netflix": F.col("netflix.id")})
    clash = with_ids.groupBy("wikidata").agg((F.coalesce(F.min("__imdb") != F.max("__imdb"), F.lit(False)) | F.coalesce(F.min("__netflix") != F.max("__netflix"), F.lit(False))).alias("__clash"))
    marked = with_ids.join(clash, "wikidata").drop("__imdb", "__netflix")
    fields = [c for c in films.columns if c not in ("wikidata", "origin", "title")]
    # Maps can't be compared, so titles are merged as entries, first come first served.
    sort = F.col(order)
    entries = F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct(sort.alias("o"), F.array_sort(F.map_entries("title")).alias("t")))))
    titles = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda a, e: F.map_concat(a, F.map_filter(F.map_from_entries(e["t"]), lambda k, _: ~F.map_contains_key(a, k))))
    one = marked.where("not __clash").groupBy("wikidata").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), sort)).alias(c) for c in fields], titles.alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("origin")))).alias("origin"))
    kept = marked.where("__clash").drop("__clash")
    return one.select(*films.columns).unionByName(kept.select(*films.columns)).unionByName(rest)


def enrich_imdb(films: DataFrame, basics: DataFrame, ratings: DataFrame, episodes: DataFrame) -> DataFrame:
    """Basics, rating and episode counts by id; films that neither basics nor ratings know stay as they are."""
    ids = films.select(F.col("imdb.id").alias("tconst")).where("tconst is not null").distinct()
    b = basics.join(ids, "tconst", "left_semi")
    r = ratings.join(ids, "tconst", "left_semi").select("tconst", F.col("averageRating").try_cast("double").alias("__rating"), F.col("numVotes").try_cast("int").alias("__votes"))
    e = episodes.withColumnRenamed("tconst", "__ep").withColumnRenamed("parentTconst", "tconst").join(ids, "tconst", "left_semi").groupBy("tconst").agg(F.count("*").alias("__episodes"), F.count_distinct("seasonNumber").alias("__seasons"))
    x = b.select("tconst", *[F.col(c).alias(f"__{c}") for c in ("primaryTitle", "originalTitle", "titleType", "startYear", "endYear", "runtimeMinutes", "genres")])
    info = x.join(r, "tconst", "full").join(e, "tconst", "left").withColumnRenamed("tconst", "__t")
    met = films.join(info, F.col("imdb.id") == F.col("__t"), "left")
    i = F.col("imdb")
    new = {"title": "__primaryTitle", "originalTitle": "__originalTitle", "type": "__titleType", "year": "__startYear", "endYear": "__endYear", "runtime": "__runtimeMinutes", "genres": "__genres", "rating": "__rating", "votes": "__votes", "episodes": "__episodes", "seasons": "__seasons"}
    out = i
    for field, source in new.items():
        out = out.withField(field, F.coalesce(source, i[field]))
    return met.withColumn("imdb", F.when(F.col("__t").isNotNull(), out).otherwise(i)).drop(*[c for c in met.columns if c.startswith("__")])


def enrich_levels(films: DataFrame, levels: DataFrame, languages: list[str] = ()) -> DataFrame:
    """Difficulty levels (tmdbId, tmdbKind, title, url, level, temporary, source, pos): of several rows of
    one key the best by level present and source, then the first."""
    rank = F.col("level").isNotNull().cast("int") * 2 + (F.col("source") != "season").cast("int")
    best = resolve.first_by_priority(levels.where("tmdbId is not null"), ["tmdbKind", "tmdbId"], rank, "pos").where("level is not null")
    b = best.select(F.col("tmdbId").alias("__id"), F.col("tmdbKind").alias("__kind"), F.struct(F.lit("ja").alias("language"), F.col("level").cast("int").alias("level"), F.col("temporary").alias("temporaryLevel"), "url").alias("__n"))
    met = films.join(b, (F.col("tmdb.id") == F.col("__id")) & (F.col("tmdb.kind") == F.col("__kind")), "left")
    wanted = filters.languages_wanted(F.col("language"), list(languages))
    return met.withColumn("natively", F.when(wanted & F.col("__n").isNotNull(), F.col("__n")).otherwise(F.col("natively"))).drop("__id", "__kind", "__n")


def suggest_identifiers(films: DataFrame, basics: DataFrame, akas: DataFrame, ratings: DataFrame, order: list[str] = filters.TITLE_TYPES) -> DataFrame:
    """For films with a catalogue id and no entity: works of a fitting type and a Japanese signal that share
    a normalised title, best first."""
    shared, lists = suggested_lists(films, basics, akas, ratings, order)
    return shared.join(lists, "titles").select("film", "best", "ranked")


def suggested_lists(films: DataFrame, basics: DataFrame, akas: DataFrame, ratings: DataFrame, order: list[str] = filters.TITLE_TYPES) -> tuple[DataFrame, DataFrame]:
    """``suggest_identifiers`` in two tables: (film, titles), and (titles, best, ranked) for each set of normalised titles. Films of
    the same titles have the same list, which is made once."""
    f = films.where("netflix.id is not null and wikidata is null").select(F.col("netflix.id").alias("film"), F.col("netflix.title").alias("t"))
    titles = basics.where(F.col("titleType").isin(order)).select(F.col("tconst").alias("work"), F.explode(F.array("primaryTitle", "originalTitle")).alias("t")).unionByName(akas.select(F.col("titleId").alias("work"), F.col("title").alias("t")))
    signal = akas.where((F.col("language") == "ja") | (F.col("region") == "JP")).select(F.col("titleId").alias("work")).unionByName(basics.where(T.has_japanese("originalTitle")).select(F.col("tconst").alias("work"))).distinct()
    # The few film titles filter the many works' titles first, then everything else.
    shared = f.select(T.title_key("t").alias("k"), "film").where("k <> ''").groupBy("film").agg(F.array_sort(F.collect_set("k")).alias("titles"))
    wanted = shared.select("titles").distinct().select("titles", F.explode("titles").alias("k"))
    hit = titles.select("work", T.title_key("t").alias("k")).where("k <> ''").join(wanted, "k").select("titles", "work").distinct()
    met = hit.join(signal, "work", "left_semi").join(basics.where(F.col("titleType").isin(order)).withColumnRenamed("tconst", "work"), "work").join(ratings.select(F.col("tconst").alias("work"), F.col("numVotes").try_cast("int").alias("votes")), "work", "left")
    rank = [resolve.type_rank("titleType", order), F.coalesce("votes", F.lit(0)).desc(), F.col("work")]
    return shared, resolve.ranked(met, "titles", rank, F.struct("work", "primaryTitle", "titleType", "startYear"))


def export_json(films: DataFrame) -> DataFrame:
    """One JSON line for each film, known keys first."""
    return upsert.canonical(films, ORDER).select(F.to_json(F.struct(*upsert.canonical(films, ORDER).columns)).alias("value"))
