from berthline.functions.numeric import (  # noqa: F401
    apply_temperature, binarize, clean_number, coalesce_zero, epoch_ms, lehmer, logit, ratio, rounded, sigmoid,
    unit_interval,
)
