"""Default stopword lists; callers add their own words or files."""

ENGLISH = (
    "a an the and or but nor so if then than that this these those of to in on at by for "
    "from with about into over under between through during before after above below up "
    "down out off again once here there when where why how all any both each few more most "
    "other some such no not only own same too very can will just should now is are was were "
    "be been being have has had having do does did doing would could may might must i me my "
    "we our you your he him his she her it its they them their what which who whom as because "
    "while until also"
).split()

CHINESE = (
    "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 他 她 它 "
    "们 与 及 或 但 而 如果 因为 所以 于 把 被 让 给 从 对 为 以 之 其 中 等"
).split()
