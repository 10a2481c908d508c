"""A library of 158 price and volume features as expressions: 13 of one bar, 29 for each of five windows."""

from __future__ import annotations

#: Fixed values, all of them: names, order and formulas are those of a public catalogue. Division adds its own guard to those written here.
WINDOWS = (5, 10, 20, 30, 60)
BAR = {
    "KMID": "(close-open)/open",
    "KLEN": "(high-low)/open",
    "KMID2": "(close-open)/(high-low+1e-12)",
    "KUP": "(high-maximum(open,close))/open",
    "KUP2": "(high-maximum(open,close))/(high-low+1e-12)",
    "KLOW": "(minimum(open,close)-low)/open",
    "KLOW2": "(minimum(open,close)-low)/(high-low+1e-12)",
    "KSFT": "(2*close-high-low)/open",
    "KSFT2": "(2*close-high-low)/(high-low+1e-12)",
    "OPEN0": "open/close",
    "HIGH0": "high/close",
    "LOW0": "low/close",
    "VWAP0": "vwap/close",
}
ROLLING = {
    "ROC": "delay(close,{w})/close",
    "MA": "ts_mean(close,{w})/close",
    "STD": "ts_std(close,{w})/close",
    "BETA": "ts_slope(close,{w})/close",
    "RSQR": "ts_rsquare(close,{w})",
    "RESI": "ts_resi(close,{w})/close",
    "MAX": "ts_max(high,{w})/close",
    "MIN": "ts_min(low,{w})/close",
    "QTLU": "ts_quantile(close,{w},0.8)/close",
    "QTLD": "ts_quantile(close,{w},0.2)/close",
    "RANK": "ts_rank(close,{w})",
    "RSV": "(close-ts_min(low,{w}))/(ts_max(high,{w})-ts_min(low,{w})+1e-12)",
    "IMAX": "ts_argmax(high,{w})/{w}",
    "IMIN": "ts_argmin(low,{w})/{w}",
    "IMXD": "(ts_argmax(high,{w})-ts_argmin(low,{w}))/{w}",
    "CORR": "ts_corr_v2(close,log(vol+1),{w})",
    "CORD": "ts_corr_v2(close/(delay(close,1)+1e-12),log(vol/(delay(vol,1)+1e-12)+1),{w})",
    "CNTP": "ts_mean(gt(close,delay(close,1)),{w})",
    "CNTN": "ts_mean(lt(close,delay(close,1)),{w})",
    "CNTD": "ts_mean(gt(close,delay(close,1)),{w})-ts_mean(lt(close,delay(close,1)),{w})",
    "SUMP": "ts_sum(maximum((close-delay(close,1)),0),{w})/(ts_sum(abs((close-delay(close,1))),{w})+1e-12)",
    "SUMN": "ts_sum(maximum(-((close-delay(close,1))),0),{w})/(ts_sum(abs((close-delay(close,1))),{w})+1e-12)",
    "SUMD": "(ts_sum(maximum((close-delay(close,1)),0),{w})-ts_sum(maximum(-((close-delay(close,1))),0),{w}))/(ts_sum(abs((close-delay(close,1))),{w})+1e-12)",
    "VMA": "ts_mean(vol,{w})/(vol+1e-12)",
    "VSTD": "ts_std(vol,{w})/(vol+1e-12)",
    "WVMA": "ts_std(abs(close/(delay(close,1)+1e-12)-1)*vol,{w})/(ts_mean(abs(close/(delay(close,1)+1e-12)-1)*vol,{w})+1e-12)",
    "VSUMP": "ts_sum(maximum((vol-delay(vol,1)),0),{w})/(ts_sum(abs((vol-delay(vol,1))),{w})+1e-12)",
    "VSUMN": "ts_sum(maximum(-((vol-delay(vol,1))),0),{w})/(ts_sum(abs((vol-delay(vol,1))),{w})+1e-12)",
    "VSUMD": "(ts_sum(maximum((vol-delay(vol,1)),0),{w})-ts_sum(maximum(-((vol-delay(vol,1))),0),{w}))/(ts_sum(abs((vol-delay(vol,1))),{w})+1e-12)",
}


def library(windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """Name -> expression."""
    return BAR | {f"{name}{w}": text.format(w=w) for name, text in ROLLING.items() for w in windows}
