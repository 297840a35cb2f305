from quiver.functions.vector import (  # noqa: F401
    cast_vector,
    check_dim,
    cosine_distance,
    distance,
    dot,
    inner_product,
    l2_distance,
    l2_distance_sq,
    let,
    norm,
    normalize,
    parse_vector,
    quantize,
    resolve_metric,
    to_text,
)
from quiver.functions.filters import eligible, filters_from, where  # noqa: F401
