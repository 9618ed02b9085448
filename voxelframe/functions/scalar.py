"""Scalar rules as SQL expressions: lenient numbers, region keys, hashes, class scores."""

from __future__ import annotations


def finite(value: str) -> str:
    """NaN and infinities become NULL."""
    return f"if(isnan({value}) or abs({value}) = double('inf'), null, {value})"


def coerce_float(text: str) -> str:
    """Number or NULL; never fails."""
    return finite(f"try_cast({text} as double)")


def region_key(case: str, label: str, variant: str | None = None) -> str:
    """``<case>_label007`` with an optional ``_aug002``."""
    if variant is None:
        return f"format_string('%s_label%03d', string({case}), {label})"
    return f"format_string('%s_label%03d_aug%03d', string({case}), {label}, {variant})"


def sample_id(case: str, label: str) -> str:
    return f"concat({case}, '__label', {label})"


# Fixed value: the file-name pattern of a region, with an optional variant.
REGION_PATTERN = "^(.+)_label([0-9]{3})(?:_aug([0-9]{3}))?$"


def parse_region_key(key: str) -> dict[str, str]:
    """Parts of a region key; NULL everywhere if the key has no marker."""

    def part(group: int) -> str:
        return f"nullif(regexp_extract({key}, '{REGION_PATTERN}', {group}), '')"

    return {
        "case_part": part(1), "label_part": f"try_cast({part(2)} as int)", "variant_part": f"try_cast({part(3)} as int)",
    }


def case_of_sample(sample: str) -> str:
    return f"split_part({sample}, '__', 1)"


def config_hash(text: str) -> str:
    """First 8 hex digits of the SHA-256 of a canonical string."""
    return f"substr(sha2({text}, 256), 1, 8)"


def variant_seed(key: str, variant: str, seed: str) -> str:
    """Stable hexadecimal seed of a (region, variant): the first 8 bytes of a SHA-256."""
    return f"substr(sha2(concat_ws(':', {key}, {variant}, {seed}), 256), 1, 16)"


def uniform(text: str) -> str:
    """Stable uniform in [0, 1) with 52 bits from a string."""
    return f"cast(conv(substr(md5({text}), 1, 13), 16, 10) as bigint) / 4503599627370496D"


def sigmoid(score: str) -> str:
    return f"1D / (1D + exp(-({score})))"


def softmax(scores: str) -> str:
    """Class probabilities of an array of scores, shifted by the maximum."""
    raw = f"transform({scores}, one -> exp(one - array_max({scores})))"
    return f"transform({raw}, part -> part / aggregate({raw}, 0D, (acc, e) -> acc + e))"


def argmax(values: str) -> str:
    return f"cast(array_position({values}, array_max({values})) - 1 as int)"
