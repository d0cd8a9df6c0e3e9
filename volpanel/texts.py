"""Published sentences. Everything in this module is a fixed value."""

from __future__ import annotations

HEADLINES = {
    "SYSTEMIC_ACUTE_STRESS": "大盘、中盘与科创期权同步进入急性保险重定价。",
    "LOCALIZED_ACUTE_STRESS": "急性重定价已出现，但尚未获得三段同步急性跳升确认。",
    "REPAIR_IN_PROGRESS": "高压后的边际修复得到多项证据确认。",
    "BROAD_PERSISTENT_PRESSURE": "压力已跨风险段扩散并进入持续层。",
    "BROAD_PRESSURE": "多个风险段的保险价格正在同步承压。",
    "LOCAL_STYLE_PRESSURE": "中盘或科创成长保险价格显著承压，大盘尚未完全确认。",
    "BLUE_CHIP_PRESSURE": "大盘权重相关保险价格显著承压，中盘与科创尚未完全确认。",
    "DOWNSIDE_TAIL_RICH": "总体冲击尚不高，但下行尾部相对中心明显偏贵。",
    "UPSIDE_CONVEXITY_PRICED": "上行凸性相对突出，当前更像认购侧事件定价。",
    "CALM_POSITIVE_VRP": "多数风险段平稳，保险价格相对事前实现方差仍有正补偿。",
    "FRAGMENTED_TRANSITION": "经济指数或期限证据分化，市场处于过渡状态。",
    "BALANCED_MARKET": "当前没有急性、广泛或显著尾部主导证据，市场处于相对均衡状态。",
    "UNKNOWN": "今日研究曲面完整，但关键历史基线或状态谓词仍不可判，暂不发布市场天气分类。",
    "NOT_OK": "今日研究曲面不足，暂不形成完整上交所期权市场天气。",
}

# (axis, pool weight, component, percentile, weight, raw value, unit, meaning)
EVIDENCE = (
    ("InsuranceLevel", 0.20, "iv30_level", "p_iv30", 1.00, "iv30_mf", "percent_iv", "30日保险价格处于自身历史高分位"),
    ("Shock", 0.25, "iv30_change_1d", "p_d1_log_iv30", 0.35, "d1_log_iv30", "log_return", "30日隐含波动率单日重定价处于自身历史高分位"),
    ("Shock", 0.25, "iv30_change_5d", "p_d5_log_iv30", 0.25, "d5_log_iv30", "log_return", "30日隐含波动率五日重定价处于自身历史高分位"),
    ("Shock", 0.25, "iv_vol_of_vol20", "p_iv_vol_of_vol20", 0.20, "iv_vol_of_vol20", "annualized", "隐含波动率自身不稳定度处于历史高分位"),
    ("Shock", 0.25, "negative_etf_return_1d", "p_neg_etf_return_1d", 0.20, "etf_return_1d", "log_return", "同步ETF下行变化处于历史高分位"),
    ("DownTail", 0.20, "down_skew25", "p_down_skew25", 0.65, "down_skew25", "iv_points", "25D下行保险参考相对中心偏贵程度处于历史高分位"),
    ("DownTail", 0.20, "down_skew25_change_5d", "p_d5_down_skew25", 0.35, "d5_down_skew25", "iv_points", "25D下行尾翼参考五日变贵速度处于历史高分位"),
    ("Persistence", 0.15, "forward_vol_30_90", "p_fvol_30_90", 0.40, "fvol_30_90", "percent_iv", "30至90日远期波动处于历史高分位"),
    ("Persistence", 0.15, "iv90_level", "p_iv90", 0.25, "iv90_mf", "percent_iv", "90日保险价格处于历史高分位"),
    ("Persistence", 0.15, "forward_vol_change_5d", "p_d5_fvol_30_90", 0.20, "d5_fvol_30_90", "iv_points", "中期波动五日扩散速度处于历史高分位"),
    ("Persistence", 0.15, "term_log_ratio", "p_term_log_ratio_30_90", 0.15, "term_log_ratio_30_90", "log_ratio", "近端相对中期的期限结构处于历史高分位"),
    ("UpTail", 0.20, "up_skew25", "p_up_skew25", 0.65, "up_skew25", "iv_points", "25D上行凸性参考相对中心偏贵程度处于历史高分位"),
    ("UpTail", 0.20, "up_skew25_change_5d", "p_d5_up_skew25", 0.35, "d5_up_skew25", "iv_points", "25D上行尾翼参考五日变贵速度处于历史高分位"),
    ("Repair", 1.00, "iv30_fall_5d", "p_neg_d5_log_iv30", 0.30, "d5_log_iv30", "log_return", "30日隐含波动率五日回落处于修复方向高分位"),
    ("Repair", 1.00, "down_skew_fall_5d", "p_neg_d5_down_skew25", 0.25, "d5_down_skew25", "iv_points", "下行尾翼五日回落处于修复方向高分位"),
    ("Repair", 1.00, "forward_vol_fall_5d", "p_neg_d5_fvol_30_90", 0.20, "d5_fvol_30_90", "iv_points", "中期远期波动五日回落处于修复方向高分位"),
    ("Repair", 1.00, "etf_rebound_5d", "p_etf_return_5d", 0.15, "etf_return_5d", "log_return", "ETF五日反弹处于修复方向高分位"),
    ("Repair", 1.00, "iv_vov_fall_5d", "p_neg_d5_iv_vol_of_vol20", 0.10, "d5_iv_vol_of_vol20", "annualized_change", "隐含波动不稳定度五日回落处于修复方向高分位"),
)

# pool -> (rows kept, percentile rule, whether the largest contribution leads)
POOLS = {
    "DRIVER": (3, "percentile >= 0.75D", True),
    "COUNTER": (2, "percentile <= 0.35D", False),
    "REPAIR": (3, "percentile >= 0.75D", True),
}

VIEW_CHANGES = {
    "ACUTE": ("hard_acute释放且Shock回落到75以下", "随后连续两个完整研究交易日出现同一非急性raw phase"),
    "REPAIR_IN_PROGRESS": ("Repair不再满足确认条件，或Pressure/Breadth重新上升", "hard_acute重新成立"),
    "BROAD_PERSISTENT_PRESSURE": ("persistent_now或broad_confirmed不再成立", "新的更高优先级phase成立"),
    "UNKNOWN": ("恢复四载体曲面与所需历史基线后顺序重放",),
    "OTHER": ("更高优先级phase成立，或新普通raw phase连续两个完整研究交易日确认",),
}

NARRATIVE = {
    "price": "保险价格：",
    "shock": "重定价与期限：Shock=",
    "term": "，Term=",
    "tail": "尾部与宽度：Tail=",
    "breadth": "，Breadth=",
    "repair": "修复：",
    "drivers": "主要驱动：",
    "counter": "反向证据：",
    "outlook": "未来判断：",
    "changes": "判断改变条件：",
    "boundary": "数据边界：真实14:56分钟收盘研究曲面；不是同步bid/ask，也不是正式可成交盘口。",
    "no_driver": "当前没有单项风险贡献超过75%历史分位",
    "no_repair": "暂无高分位修复证据",
    "proxies": "研究代理：",
    "stop": "。",
    "join": "；",
    "of": "的",
}
