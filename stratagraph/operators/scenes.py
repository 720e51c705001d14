"""Charts of a graph: which modules are shown, and how files cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph

# Frameworks and headers that come with a platform, in the order of their kinds.
SWIFT = [
    "Foundation", "SwiftUI", "AppKit", "UIKit", "Combine", "Observation", "CoreGraphics", "CoreData", "CoreServices", "CoreFoundation", "CryptoKit", "Dispatch", "os", "OSLog",
    "Darwin", "Metal", "MetalKit", "RealityKit", "RealityFoundation", "SceneKit", "SpriteKit", "AVFoundation", "AVKit", "QuartzCore", "CoreLocation", "MapKit", "WebKit",
    "Network", "Security", "SystemConfiguration", "XCTest", "Testing", "SwiftData", "Charts", "WidgetKit", "StoreKit", "CloudKit", "UserNotifications", "Photos", "PhotosUI",
    "Vision", "CoreML", "NaturalLanguage", "Speech", "Contacts", "EventKit", "HealthKit", "HomeKit", "GameKit", "GameplayKit", "ARKit", "PencilKit", "QuickLook",
    "SafariServices", "MessageUI", "CoreBluetooth", "CoreMotion", "CoreImage", "CoreText", "CoreVideo", "CoreMedia", "CoreAudio", "AudioToolbox", "VideoToolbox", "ImageIO",
    "UniformTypeIdentifiers", "Accessibility", "LocalAuthentication", "AuthenticationServices", "BackgroundTasks", "AppIntents", "TipKit", "PackageDescription", "Swift",
    "simd", "Accelerate", "GroupActivities", "TabularData", "CreateML", "Playgrounds", "JavaScriptCore", "CallKit", "PushKit", "Intents", "IntentsUI", "CarPlay", "WatchKit",
    "ClockKit", "WatchConnectivity", "ExternalAccessory", "FileProvider", "FinderSync", "ServiceManagement", "IOKit", "DiskArbitration",
]
C = [
    "stdio.h", "stdlib.h", "string.h", "math.h", "time.h", "ctype.h", "errno.h", "float.h", "limits.h", "locale.h", "setjmp.h", "signal.h", "stdarg.h", "stddef.h", "assert.h",
    "stdint.h", "stdbool.h", "inttypes.h", "complex.h", "fenv.h", "tgmath.h", "wchar.h", "wctype.h", "iso646.h", "unistd.h", "fcntl.h", "sys/types.h", "sys/stat.h",
    "sys/time.h", "sys/socket.h", "sys/mman.h", "sys/wait.h", "sys/ioctl.h", "netinet/in.h", "arpa/inet.h", "netdb.h", "pthread.h", "semaphore.h", "dirent.h", "dlfcn.h",
    "poll.h", "termios.h", "syslog.h", "pwd.h", "grp.h", "regex.h", "glob.h", "libgen.h", "strings.h", "memory.h", "malloc.h", "stdatomic.h", "threads.h",
]
PYTHON = [
    "os", "sys", "re", "json", "math", "typing", "collections", "itertools", "functools", "pathlib", "datetime", "time", "subprocess", "logging", "unittest", "abc", "io",
    "random", "string", "threading", "multiprocessing", "socket", "struct", "enum", "dataclasses", "argparse", "copy", "pickle", "hashlib", "base64", "tempfile", "shutil",
    "glob", "csv", "sqlite3", "urllib", "http", "email", "html", "xml", "asyncio", "contextlib", "inspect", "traceback", "warnings", "weakref", "types", "operator",
    "numbers", "decimal", "fractions", "statistics", "array", "bisect", "heapq", "queue", "signal", "errno", "stat", "platform", "getpass", "textwrap", "unicodedata",
    "codecs", "locale", "ctypes", "importlib", "pkgutil", "site", "sysconfig", "zlib", "gzip", "bz2", "lzma", "zipfile", "tarfile", "configparser", "secrets", "uuid",
    "ipaddress", "selectors", "ssl", "socketserver", "pdb", "profile", "cProfile", "timeit", "trace", "gc", "atexit", "builtins", "__future__",
]
#: Kinds of edges that a chart shows.
SHOWN_KINDS = ("containsPhysical", "declares", "imports", "dependsOn", "references", "refersToSymbol", "builds", "authoredBy", "ownedBy")


def is_system_module(lang: Column, name: Column) -> Column:
    """Part of a platform or a standard library: by full name, in Python by the first part; never in other languages."""
    first = F.substring_index(name, ".", 1)
    return F.when(lang == "swift", name.isin(SWIFT)).when(lang == "python", first.isin(PYTHON)).when(lang == "c", name.isin(C)).otherwise(False)


def charted_modules(modules: DataFrame, folders: DataFrame, external: bool = False) -> DataFrame:
    """lang, name, internal of modules: those named like a folder always, others that are no system modules only with `external`."""
    named = folders.select(F.element_at(F.split("path", "/"), -1).alias("f")).distinct().withColumn("internal", F.lit(True))
    rows = modules.join(named, F.col("name") == F.col("f"), "left").withColumn("internal", F.coalesce("internal", F.lit(False)))
    return rows.where(F.col("internal") | (F.lit(external) & ~is_system_module(F.col("lang"), F.col("name")))).select("lang", "name", "internal")


def cluster_key(grouping: str, path: Column, kind: Column, role: Column | None = None, owner: Column | None = None) -> Column:
    """The cluster of a node under one of the groupings: area, folder, layer, pattern, role, owner or none."""
    layers = F.when(kind == "module", "External").when(X.is_test(path), "Tests").otherwise("Sources")
    none = F.lit("")
    return {"area": X.area(path), "folder": X.folder(path), "layer": layers, "pattern": X.pattern_role(path, kind), "role": none if role is None else F.coalesce(role, F.lit("Leaf")), "owner": none if owner is None else F.coalesce(owner, F.lit("Unowned")), "none": none}[grouping]


def dependency_scene(edges: DataFrame, charted: DataFrame) -> DataFrame:
    """Imports and references (src, dst, kind, ...) whose ends are both charted (node)."""
    return graph.edges_among(edges.where(F.col("kind").isin("imports", "references")), charted)


def symbol_scene(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of symbol references and what they touch."""
    e = edges.where("kind = 'refersToSymbol'")
    return nodes.join(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi"), e


def build_scene(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of builds edges: their ends, and every build target whether or not it has an edge."""
    e = edges.where("kind = 'builds'")
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(nodes.where("kind = 'buildTarget'").select("node")).distinct()
    return nodes.join(ends, "node", "left_semi"), e


def shown_edges(edges: DataFrame, nodes: DataFrame, repo: str) -> DataFrame:
    """src, dst, kind, weight of the charted kinds that start in a repository's nodes (node, repo); weight is the number of references, else of
    commits, else 1."""
    own = nodes.where(F.col("repo") == repo).select("node")
    e = edges.where(F.col("kind").isin(*SHOWN_KINDS)).join(own, F.col("src") == F.col("node"), "left_semi")
    return e.select("src", "dst", "kind", F.coalesce("refs", "commits", F.lit(1)).cast("long").alias("weight"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, cyclic (edges within a strong component or to themselves), orphans (nodes that no edge touches)."""
    e = graph.settled(edges.select("src", "dst"))
    cyclic = graph.cyclic_edges(e, graph.strong_components(e)).agg(F.count(F.lit(1)).alias("cyclic"))
    touched = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    orphans = nodes.select("node").distinct().join(touched, "node", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    n, m = nodes.agg(F.count_distinct("node").alias("nodes")), e.agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(m).crossJoin(cyclic).crossJoin(orphans)  # one row each


def degree_trend(edges: DataFrame, revisions: DataFrame) -> DataFrame:
    """revision, edges: how many edges (valid_from, valid_to) are valid at each revision, by events and a running sum instead of a range join."""
    start = edges.groupBy(F.col("valid_from").alias("r")).agg(F.count(F.lit(1)).alias("d"))
    end = edges.where("valid_to is not null").groupBy(F.col("valid_to").alias("r")).agg((-F.count(F.lit(1))).alias("d"))
    asked = revisions.select(F.col("revision").alias("r"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked"))
    steps = start.unionByName(end).withColumn("asked", F.lit(False)).unionByName(asked)  # a row a revision
    run = steps.groupBy("r").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    return run.withColumn("edges", F.sum("d").over(Window.orderBy("r"))).where("asked").select(F.col("r").alias("revision"), "edges")


def distinct_trend(facts: DataFrame, key: str, revisions: DataFrame) -> DataFrame:
    """revision, n: how many keys have a fact (key, valid_from, valid_to) that is valid at each revision. A key's intervals are merged where they meet, then
    starts and ends are counted as in degree_trend. Of facts that start together the longest counts, so a key has a row a revision at most when it is sorted."""
    last = F.lit((1 << 63) - 1)
    end = F.coalesce(F.col("valid_to").cast("long"), last)
    own = facts.where(F.col(key).isNotNull() & (end > F.col("valid_from"))).groupBy(F.col(key).alias("key"), F.col("valid_from").cast("long").alias("valid_from")).agg(F.max(end).alias("end"))
    w = Window.partitionBy("key").orderBy("valid_from")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("fresh", F.when(before >= F.col("valid_from"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    merged = marked.groupBy("key", "island").agg(F.min("valid_from").alias("valid_from"), F.max("end").alias("end"))
    return degree_trend(merged.select("valid_from", F.nullif("end", last).alias("valid_to")), revisions).withColumnRenamed("edges", "n")


def molecules(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms (node, molecule, radius), bonds (a, b) and molecules (molecule, atoms, x, y, z) of a scene of nodes (node, cluster).

    An atom's radius grows with its degree; bonds are undirected, each once, between nodes of the scene; molecules stand evenly on a sphere, in
    order of their names, a sphere that grows with their number.
    """
    inner = graph.edges_among(edges, nodes)
    size = graph.degrees(inner)
    atoms = nodes.join(size, "node", "left").select("node", F.col("cluster").alias("molecule"), (0.5 * (1 + 0.55 * F.pow(F.coalesce("degree", F.lit(0)), F.lit(1 / 3)))).alias("radius"))
    bonds = inner.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    counted = atoms.groupBy("molecule").agg(F.count(F.lit(1)).alias("atoms"))  # a row a cluster
    i = F.row_number().over(Window.orderBy("molecule")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    placed = counted.withColumns({"i": i, "n": n}).withColumn("y", F.when(F.col("n") > 1, 1 - 2 * (F.col("i") + 0.5) / F.col("n")).otherwise(0.0))
    ring, turn, scale = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("y"))), F.col("i") * (math.pi * (3 - math.sqrt(5))), 14 * F.cbrt(F.col("n"))
    return atoms, bonds, placed.select("molecule", "atoms", (F.cos(turn) * ring * scale).alias("x"), (F.col("y") * scale).alias("y"), (F.sin(turn) * ring * scale).alias("z"))
