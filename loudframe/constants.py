"""Fixed values of the loudness method, the frame format and the tag formats.

The numbers and words in this module are part of the published method and file
formats. They have to be exactly these for results to agree with other tools.
"""

from __future__ import annotations

import math

# --- fixed values: gain field -------------------------------------------------
STEP_DB = 1.5
GAIN_MIN = 0
GAIN_MAX = 255

# --- fixed values: loudness scale ---------------------------------------------
REFERENCE_DB = 89.0
PINK_LEVEL_DB = 64.82
WINDOW_MS = 50
HISTOGRAM_BINS = 12000
HISTOGRAM_OFFSET = 2000
BINS_PER_DB = 100
PERCENTILE = 0.95
EMPTY_LOUDNESS_DB = -20.0
LOG_FLOOR = 1e-37
FILTER_BIAS = 1e-10
PCM_SCALE = 32768.0
PCM32_SCALE = 2147483648.0
CLIP_WARNING_PEAK = 0.9999

# --- fixed values: file kinds --------------------------------------------------
AUDIO_EXTENSIONS = ("mp3", "m4a", "aac", "mp4")
DESKTOP_EXTENSIONS = ("mp3", "m4a", "aac")
MP4_BRANDS = ("M4A ", "M4B ", "M4P ", "M4V ", "mp41", "mp42", "isom", "iso2")

# --- fixed values: frame header tables ------------------------------------------
BITRATES_V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_V2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
FRAME_RATES = {
    "MPEG1": (44100, 48000, 32000),
    "MPEG2": (22050, 24000, 16000),
    "MPEG2.5": (11025, 12000, 8000),
}
CHANNEL_MODES = ("Stereo", "Joint Stereo", "Dual Channel", "Mono")

# --- fixed values: tag keys -----------------------------------------------------
UNDO_KEY = "MP3GAIN_UNDO"
MINMAX_KEY = "MP3GAIN_MINMAX"
TRACK_GAIN_KEY = "REPLAYGAIN_TRACK_GAIN"
TRACK_PEAK_KEY = "REPLAYGAIN_TRACK_PEAK"
ALBUM_GAIN_KEY = "REPLAYGAIN_ALBUM_GAIN"
ALBUM_PEAK_KEY = "REPLAYGAIN_ALBUM_PEAK"
LEVEL_KEYS = (TRACK_GAIN_KEY, TRACK_PEAK_KEY, ALBUM_GAIN_KEY, ALBUM_PEAK_KEY)
REPORT_KEYS = (UNDO_KEY, MINMAX_KEY) + LEVEL_KEYS
APE_PREAMBLE = b"APETAGEX"
APE_VERSION = 2000
MP4_NAMESPACE = "com.apple.iTunes"

# --- fixed values: equal-loudness shaping filter, order 10 ------------------------
# Per sample rate: ten feedback weights (delay 1..10), then eleven feed-forward
# weights (delay 0..10). 88,200 Hz is left out: the published weights for that rate
# are unstable (poles outside the unit circle), so no meaningful level exists.
SHAPING_FILTERS = {
    96000: (
        (-7.22103125152679, 24.7034187975904, -52.6825833623896, 77.4825736677539,
         -82.0074753444205, 63.1566097101925, -34.889569769245, 13.2126852760198,
         -3.09445623301669, 0.340344741393305),
        (0.006471345933032, -0.02567678242161, 0.049805860704367, -0.05823001743528,
         0.040611847441914, -0.010912036887501, -0.00901635868667, 0.012448886238123,
         -0.007206683749426, 0.002167156433951, -0.000261819276949),
    ),
    64000: (
        (-5.74819833657784, 16.246507961894, -29.9691822642542, 40.027597579378,
         -40.3209196052655, 30.8542077487718, -17.5965138737281, 7.10690214103873,
         -1.82175564515191, 0.223619893831468),
        (0.021776466467053, -0.062376961003801, 0.107731165328514, -0.150994515142316,
         0.170334807313632, -0.157984942890531, 0.121639833268721, -0.074094040816409,
         0.031282852041061, -0.00755421235941, 0.00117925454213),
    ),
    48000: (
        (-3.84664617118067, 7.81501653005538, -11.34170355132042, 13.05504219327545,
         -12.28759895145294, 9.4829380631979, -5.87257861775999, 2.75465861874613,
         -0.86984376593551, 0.13919314567432),
        (0.038575994352, -0.02160367184185, -0.00123395316851, -0.00009291677959,
         -0.01655260341619, 0.02161526843274, -0.02074045215285, 0.00594298065125,
         0.00306428023191, 0.00012025322027, 0.00288463683916),
    ),
    44100: (
        (-3.47845948550071, 6.36317777566148, -8.54751527471874, 9.4769360780128,
         -8.81498681370155, 6.85401540936998, -4.39470996079559, 2.19611684890774,
         -0.75104302451432, 0.13149317958808),
        (0.0541865640643, -0.02911007808948, -0.00848709379851, -0.00851165645469,
         -0.00834990904936, 0.02245293253339, -0.02596338512915, 0.01624864962975,
         -0.00240879051584, 0.00674613682247, -0.00187763777362),
    ),
    32000: (
        (-2.37898834973084, 2.84868151156327, -2.64577170229825, 2.23697657451713,
         -1.67148153367602, 1.00595954808547, -0.45953458054983, 0.16378164858596,
         -0.05032077717131, 0.0234789740702),
        (0.15457299681924, -0.09331049056315, -0.06247880153653, 0.02163541888798,
         -0.05588393329856, 0.04781476674921, 0.00222312597743, 0.03174092540049,
         -0.01390589421898, 0.00651420667831, -0.00881362733839),
    ),
    24000: (
        (-1.61273165137247, 1.0797749225997, -0.2565625775407, -0.1627671912044,
         -0.22638893773906, 0.39120800788284, -0.22138138954925, 0.04500235387352,
         0.02005851806501, 0.00302439095741),
        (0.30296907319327, -0.22613988682123, -0.08587323730772, 0.03282930172664,
         -0.00915702933434, -0.02364141202522, -0.00584456039913, 0.06276101321749,
         -0.00000828086748, 0.00205861885564, -0.02950134983287),
    ),
    22050: (
        (-1.49858979367799, 0.87350271418188, 0.12205022308084, -0.80774944671438,
         0.47854794562326, -0.12453458140019, -0.04067510197014, 0.08333755284107,
         -0.04237348025746, 0.02977207319925),
        (0.33642304856132, -0.2557224142557, -0.11828570177555, 0.11921148675203,
         -0.07834489609479, -0.0046997791438, -0.0058950022444, 0.05724228140351,
         0.00832043980773, -0.0163538138454, -0.0176017656815),
    ),
    16000: (
        (-0.62820619233671, 0.29661783706366, -0.372563729424, 0.00213767857124,
         -0.42029820170918, 0.22199650564824, 0.00613424350682, 0.06747620744683,
         0.05784820375801, 0.03222754072173),
        (0.4491525660845, -0.14351757464547, -0.22784394429749, -0.01419140100551,
         0.04078262797139, -0.12398163381748, 0.04078565135648, 0.10478503600251,
         -0.01863887810927, -0.03193428438915, 0.00541907748707),
    ),
    12000: (
        (-1.04800335126349, 0.29156311971249, -0.26806001042947, 0.00819999645858,
         0.45054734505008, -0.33032403314006, 0.0673936833311, -0.04784254229033,
         0.01639907836189, 0.01807364323573),
        (0.56619470757641, -0.75464456939302, 0.1624213774223, 0.16744243493672,
         -0.18901604199609, 0.3093178284183, -0.27562961986224, 0.00647310677246,
         0.08647503780351, -0.0378898455484, -0.00588215443421),
    ),
    11025: (
        (-0.51035327095184, -0.31863563325245, -0.20256413484477, 0.1472815413433,
         0.38952639978999, -0.23313271880868, -0.05246019024463, -0.02505961724053,
         0.02442357316099, 0.01818801111503),
        (0.58100494960553, -0.53174909058578, -0.14289799034253, 0.17520704835522,
         0.02377945217615, 0.15558449135573, -0.25344790059353, 0.01628462406333,
         0.06920467763959, -0.03721611395801, -0.00749618797172),
    ),
    8000: (
        (-0.2504987195602, -0.43193942311114, -0.03424681017675, -0.04678328784242,
         0.26408300200955, 0.15113130533216, -0.17556493366449, -0.18823009262115,
         0.05477720428674, 0.0470440968812),
        (0.53648789255105, -0.42163034350696, -0.00275953611929, 0.04267842219415,
         -0.10214864179676, 0.14590772289388, -0.02459864859345, -0.11202315195388,
         -0.04060034127, 0.0478866554818, -0.02217936801134),
    ),
}

# --- fixed values: second-order high-pass, leading feed-forward weight per rate ---
HIGH_PASS_LEAD = {
    96000: 0.99308203517541,
    64000: 0.989641019334721,
    48000: 0.98621192462708,
    44100: 0.98500175787242,
    32000: 0.97938932735214,
    24000: 0.97531843204928,
    22050: 0.97316523498161,
    16000: 0.96454515552826,
    12000: 0.96009142950541,
    11025: 0.95856916599601,
    8000: 0.94597685600279,
}


def high_pass_weights(sample_rate: int) -> tuple[tuple[float, float], tuple[float, float, float]]:
    """Second-order Butterworth high-pass, fully determined by its leading weight.

    With ``k`` the warped corner frequency, the leading weight is
    ``1 / (1 + sqrt(2) k + k^2)``; solving for ``k`` gives the other weights.
    Returns ``(feedback delays 1..2, feed-forward delays 0..2)``.
    """
    lead = HIGH_PASS_LEAD[sample_rate]
    root = math.sqrt(2.0)
    k = (math.sqrt(2.0 + 4.0 * (1.0 / lead - 1.0)) - root) / 2.0
    feedback = (2.0 * (k * k - 1.0) * lead, (1.0 - root * k + k * k) * lead)
    return feedback, (lead, -2.0 * lead, lead)
