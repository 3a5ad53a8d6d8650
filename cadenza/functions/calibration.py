"""Calibration constants and score functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.artifacts import packaged_contract

# Calibrations fitted elsewhere, by layer. They stand in the package's contract file.
CONTRACT = packaged_contract()
SPECTRUM = {int(k): v for k, v in CONTRACT["spectrum"].items()}
LOCAL = {int(k): {**v, "coefficients": tuple(v["coefficients"])} for k, v in CONTRACT["local"].items()}
TOPOLOGY, SPECTRUM_CONTROL = CONTRACT["topology"], CONTRACT["spectrum_control"]
TEACHER_LOGIT, GLOBAL_LOGIT = tuple(CONTRACT["teacher_logit"]), tuple(CONTRACT["global_logit"])
LAYERS = tuple(CONTRACT["layers"])


def clipped_logit(p: Column, eps: float = 1e-5) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(c / (1 - c))


def standardized(value: Column, mean: float, sd: float) -> Column:
    return (value - F.lit(mean)) / F.lit(sd)


def stable_sigmoid(x: Column) -> Column:
    """exp never sees a positive argument."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def layer_table(spark: SparkSession, rows: dict[int, dict]) -> DataFrame:
    """A calibration as a table: a row per layer, for a broadcast join."""
    names = list(next(iter(rows.values())))
    return spark.createDataFrame([(k, *[v[n] for n in names]) for k, v in rows.items()], "layer int, " + ", ".join(f"{n} {'array<double>' if n == 'coefficients' else 'double'}" for n in names))


def spectrum_score(features: DataFrame, key: str, calibration: dict[int, dict] = SPECTRUM) -> DataFrame:
    """features (key, length, layer, score) -> key, layers_seen, spectrum_score: the mean of the layers' length-residual z.

    A layer without calibration stops the query, as does a repeated or missing layer.
    """
    cal = F.broadcast(layer_table(features.sparkSession, calibration))  # a row per layer
    z = (F.log1p("score") - (F.col("slope") * F.log2("length") + F.col("intercept")) - F.col("mean")) / F.col("sd")
    joined = features.join(cal, "layer", "left").withColumn("z", F.when(F.col("sd").isNull(), F.raise_error(F.lit("layer without calibration"))).otherwise(z))
    out = joined.groupBy(key).agg(F.count("*").alias("layers_seen"), F.count_distinct("layer").alias("n_layers"), F.avg("z").alias("spectrum_score"))
    whole = (F.col("layers_seen") == len(calibration)) & (F.col("n_layers") == len(calibration))
    return out.withColumn("spectrum_score", F.when(whole, F.col("spectrum_score")).otherwise(F.raise_error(F.lit("layers missing or repeated")))).drop("n_layers")


def layer_score_map(features: Column) -> Column:
    """features (array of structs with layer and score) -> map of layer to score.

    A repeated layer stops the query (DUPLICATED_MAP_KEY), as does a score that is missing,
    not finite or not above -1; no features give an empty map.
    """
    entries = F.transform(F.coalesce(features, F.array().cast("array<struct<layer: int, score: double>>")), lambda f: F.struct(f["layer"].cast("int").alias("layer"), f["score"].cast("double").alias("score")))
    bad = F.filter(entries, lambda f: ~F.coalesce((f["score"] > -1.0) & (f["score"] < float("inf")), F.lit(False)) | f["layer"].isNull())
    fault = F.concat(F.lit("invalid layer score: "), F.to_json(bad))
    checked = F.when(F.size(bad) == 0, entries).otherwise(F.raise_error(fault).cast("array<struct<layer: int, score: double>>"))
    return F.map_from_entries(checked)


def frozen_spectrum(scores: Column, length: Column, calibration: dict[int, dict] = SPECTRUM) -> Column:
    """scores (map of layer to score) -> struct of the selected layers, a map of each layer to its raw, log, expected and residual score and z, and the mean z.

    Missing selected layers and a length below 1 stop the query; other layers are not used.
    """
    layers = list(calibration)
    absent = F.array_except(F.array(*[F.lit(k) for k in layers]), F.map_keys(scores))
    fault = F.when(~F.coalesce(length >= 1, F.lit(False)), "length must be positive").when(F.size(absent) > 0, F.concat(F.lit("missing selected layers: "), F.to_json(absent)))
    whole = F.when(fault.isNull(), scores).otherwise(F.raise_error(fault).cast("map<int,double>"))
    entries = []
    for layer, own in calibration.items():
        raw = F.element_at(whole, F.lit(layer))
        expected = F.lit(own["slope"]) * F.log2(length) + F.lit(own["intercept"])
        residual = F.log1p(raw) - expected
        z = (residual - F.lit(own["mean"])) / F.lit(own["sd"])
        entries += [F.lit(str(layer)), F.struct(raw.alias("raw_score"), F.log1p(raw).alias("log_score"), expected.alias("expected_control_log_score"), residual.alias("length_residual"), z.alias("length_residual_z"))]
    zs = F.array(*[e["length_residual_z"] for e in entries[1::2]])
    mean = F.aggregate(zs, F.lit(0.0), lambda s, z: s + z) / len(layers)
    return F.struct(F.array(*[F.lit(k) for k in layers]).alias("selected_layers"), F.create_map(*entries).alias("layers"), mean.alias("score"))


def window_z(score: Column, window: Column, length: Column, coefficients: Column, mean: Column, sd: Column) -> Column:
    expected = coefficients[0] + coefficients[1] * F.log2(window) + coefficients[2] * F.log2(length)
    return (F.log1p(score) - expected - mean) / sd


def operational_scores(status: Column, candidates: Column, open_minimum: Column, spectrum: Column, config: dict = TOPOLOGY, control: dict = SPECTRUM_CONTROL) -> dict[str, Column]:
    """Candidate-corrected topology score, its z, the spectrum's z and their mean."""
    ok = status == "ok"
    expected = F.when(ok, F.lit(config["intercept"]) + F.lit(config["coefficient"]) * F.log1p(candidates.cast("double")))
    corrected = F.when(ok, (open_minimum - expected) / F.lit(config["residual_sd"])).otherwise(F.lit(config["no_call"]))
    topology_z = standardized(corrected, config["mean"], config["sd"])
    spectrum_z = standardized(spectrum, control["mean"], control["sd"])
    return {
        "candidate_count": F.when(ok, candidates).otherwise(F.lit(0)),
        "open_score_raw": F.when(ok, open_minimum),
        "expected_open_score": expected,
        "corrected_topology_score": corrected,
        "topology_z": topology_z,
        "spectrum_z": spectrum_z,
        "fusion_score": 0.5 * topology_z + 0.5 * spectrum_z,
    }


def compose_score(state_p: Column, topology_z: Column, global_p: Column, teacher: tuple[float, float], overall: tuple[float, float], base: tuple[float, float] = (0.5, 0.5), top: tuple[float, float] = (0.75, 0.25)) -> dict[str, Column]:
    """Two probabilities and a topology z to one base, one primary and one discovery score. Weights sum to 1."""
    for pair in (base, top):
        if min(pair) < 0 or abs(sum(pair) - 1) > 1e-12:
            raise ValueError("weights must be nonnegative and sum to one")
    teacher_z, global_z = standardized(clipped_logit(state_p), *teacher), standardized(clipped_logit(global_p), *overall)
    base_score = base[0] * teacher_z + base[1] * topology_z
    return {"teacher_z": teacher_z, "global_z": global_z, "base_score": base_score, "primary_score": top[0] * base_score + top[1] * global_z, "discovery_score": 0.5 * teacher_z + 0.5 * global_z}


def router_features(mean: Column, q90: Column, z: Column) -> list[Column]:
    return [mean, q90, z, mean * z]


#: The router's features, in order.
ROUTER_FEATURES = ("state_mean_logit", "state_q90_logit", "topology_control_z", "state_mean_logit_x_topology_control_z")


def validated_router(model: dict, features: int = len(ROUTER_FEATURES)) -> dict:
    """The model, if it is whole: mean and scale per feature, coefficients per category and feature, an intercept per category, all finite, scales positive.

    Where it names its features or categories, features must be ``ROUTER_FEATURES`` in order, and categories distinct and as many as it has rows.
    """
    mean, scale, rows, intercepts = (model[k] for k in ("mean", "scale", "coefficients", "intercepts"))
    if len(mean) != features or len(scale) != features:
        raise ValueError("router scaler dimensions disagree with its features")
    if not rows or any(len(row) != features for row in rows) or len(intercepts) != len(rows):
        raise ValueError("router coefficient or intercept dimensions disagree")
    if not all(math.isfinite(x) for x in (*mean, *scale, *intercepts, *(c for row in rows for c in row))):
        raise ValueError("router model contains nonfinite parameters")
    if min(scale) <= 0:
        raise ValueError("router model shape or scale is invalid: scales must be positive")
    if "features" in model and tuple(model["features"]) != ROUTER_FEATURES:
        raise ValueError("router features differ from this library's, or in their order")
    if "categories" in model and (len(model["categories"]) != len(rows) or len(set(model["categories"])) != len(rows)):
        raise ValueError("router categories are incomplete or repeated")
    return model


def router_probabilities(features: list[Column], model: dict) -> list[Column]:
    """One-versus-rest logistic scores of standardised features, normalised to sum 1, in the order of the model's rows. A feature that isn't finite stops the query."""
    validated_router(model, len(features))
    features = [F.when(F.coalesce(F.abs(f) < float("inf"), F.lit(False)), f).otherwise(F.raise_error(F.lit("router feature is missing or not finite")).cast("double")) for f in features]
    scaled = [(f - F.lit(m)) / F.lit(s) for f, m, s in zip(features, model["mean"], model["scale"], strict=True)]
    raw = [stable_sigmoid(sum((F.lit(c) * x for c, x in zip(row, scaled, strict=True)), F.lit(b))) for row, b in zip(model["coefficients"], model["intercepts"], strict=True)]
    total = sum(raw[1:], raw[0])
    return [r / total for r in raw]


def routed_category(probabilities: list[Column], categories: list[str], threshold: float = 0.5) -> Column:
    """The most probable category (of equal ones the first), unresolved below the threshold."""
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (p, c) in enumerate(zip(probabilities, categories, strict=True))]))
    return F.when(best["p"] >= threshold, best["c"]).otherwise("unresolved")


# Structural class codes.
ARCHITECTURES = {"2": "fibrous_repeat", "3": "elongated_repeat", "4": "closed_repeat", "5": "beads_on_a_string"}


def architecture_label(classes: Column) -> Column:
    """Name of a record's set of class codes."""
    distinct = F.array_distinct(classes)
    names = F.create_map(*[F.lit(x) for kv in ARCHITECTURES.items() for x in kv])
    return F.when(F.size(distinct) == 0, "non_repeat").when(F.size(distinct) > 1, "mixed_repeat_architecture").otherwise(F.coalesce(F.try_element_at(names, F.get(distinct, F.lit(0))), F.lit("other_repeat_architecture")))
