"""Fixed values of the snippet rules: word lists and patterns whose results must not change."""

# Marker of the game's own command in a launch line.
COMMAND = "%command%"

# Wrapper programs.
WRAPPERS = (
    "gamemoderun",
    "mangohud",
    "gamescope",
    "prime-run",
    "obs-gamecapture",
    "game-performance",
    "dlss-swapper",
)

# Environment assignments found in text, and prefixes and names accepted as assignments.
ENV_IN_TEXT = (
    r"\b(PROTON_|DXVK_|VKD3D_|RADV_|MESA_|WINE|__GL_|NVIDIA_|AMD_|SDL_|WINEDLLOVERRIDES|MANGOHUD|ENABLE_VKBASALT"
    r"|PULSE_LATENCY_MSEC|DXVK_FRAME_RATE|DXVK_HDR|ENABLE_HDR_WSI|MANGOHUD_CONFIG|LD_PRELOAD)"
    r'\w*="?[^"\s;|&`<>]+"?'
)
ENV_PREFIXES = (
    "PROTON_", "DXVK_", "VKD3D_", "RADV_", "MESA_", "WINE", "__GL_", "NVIDIA_", "AMD_", "SDL_",
)
ENV_NAMES = (
    "WINEDLLOVERRIDES", "MANGOHUD", "ENABLE_VKBASALT", "PULSE_LATENCY_MSEC", "LD_PRELOAD", "STEAM_COMPAT",
    "DXVK_FRAME_RATE", "DXVK_HDR", "ENABLE_HDR_WSI", "MANGOHUD_CONFIG",
)
ENV_LABEL_PREFIXES = ("PROTON_", "DXVK_", "VKD3D_", "RADV_", "MESA_", "__GL_", "NVIDIA_", "SDL_")

# Signs of a line that must not be copied into a shell.
DANGEROUS_WORDS = (
    "sudo", "rm ", "rmdir", "mkfs", "dd if=", "chmod", "chown", "pkexec", "wget ", "curl ",
)
SHELL_OPERATORS = ("$(", "`", "&&", "||", ";|")

# Lines of a note which only repeat form answers.
FORM_LINES = ("verdict:", "windowingfaults:", "stabilityfaults:", "performancefaults:")

COPYABLE_KINDS = ("launch_option", "env_var", "wrapper")

# Kind and pattern of phrases looked for in notes, each taken once per report.
PHRASES = (
    ("workaround", r"\buse\s+Proton\s+Experimental\b"),
    ("workaround", r"\buse\s+(?:Proton\s+)?GE[-\s]?Proton[-\d]*\b"),
    ("workaround", r"\b(?:switch|change|set)\s+(?:the\s+)?(?:compatibility\s+)?\s*tool\s+to\s+Proton\b"),
    ("workaround", r"\buse\s+Proton\s+[\d.]+\b"),
    ("workaround", r"\bdisabl(?:e|ing)\s+(?:the\s+)?intro\s+videos?\b"),
    ("workaround", r"\bskip\s+(?:the\s+)?intro\s+videos?\b"),
    ("workaround", r"\bskip\s+(?:the\s+)?intro\b"),
    ("workaround", r"\bdisabl(?:e|ing)\s+(?:the\s+)?launcher\b"),
    ("workaround", r"\b(?:run|start|launch|use|play)\s+(?:in\s+)?(?:windowed|window)\s+mode\b"),
    ("workaround", r"\b(?:force|set)\s+(?:to\s+)?(?:windowed|window)\s+mode\b"),
    ("workaround", r"\bdisabl(?:e|ing)\s+(?:the\s+)?fullscreen\b"),
    ("workaround", r"\bdisabl(?:e|ing)\s+(?:Steam\s+)?input\b"),
    ("workaround", r"\buse\s+(?:the\s+)?native\s+(?:Linux\s+)?version\b"),
    ("workaround", r"\b(?:install|use)\s+(?:protontricks|winetricks)\b"),
    ("workaround", r"\banti[-\s]?cheat\b"),
    ("workaround", r"\bEAC\s+(?:enabled|support)\b"),
    ("diagnostic", r"\bblack\s+screen\b"),
    ("diagnostic", r"\bwhite\s+screen\b"),
    ("diagnostic", r"\bscreen\s+flick(?:er|ering)\b"),
    ("diagnostic", r"\bno\s+(?:audio|sound)\b"),
    ("diagnostic", r"\baudio\s+(?:crackl|stutter|cut|lag)\w*\b"),
    ("diagnostic", r"\bcontroller\s+(?:not\s+)?(?:work|detect|respond)\b"),
    ("diagnostic", r"\b(?:freeze|hang|lock\s*up)s?\s+(?:on|at|during|after)?\b"),
    ("diagnostic", r"\bcrash(?:es)?\s+(?:on|at|during|after|to|upon|desktop|lobby)\b"),
    ("note", r"\bno\s+tweaks?\s+required\b"),
    ("note", r"\b(?:works|runs)\s+(?:out\s+of\s+the\s+box|perfectly|flawlessly)\b"),
)

# Words of which a text must hold one for the phrase pattern of the same place to match; they save
# most pattern matches.
PHRASE_HINTS = (
    ("experimental",), ("proton",), ("tool",), ("proton",), ("intro",), ("intro",), ("intro",), ("launcher",),
    ("mode",), ("mode",), ("fullscreen",), ("input",), ("version",), ("tricks",), ("cheat",), ("eac",),
    ("screen",), ("screen",), ("screen",), ("audio", "sound"), ("audio",), ("controller",),
    ("freeze", "hang", "lock"), ("crash",), ("required",), ("works", "runs"),
)

# Pattern, label, description and category of known snippets; the first that matches counts.
KNOWN_SNIPPETS = (
    ("proton_enable_wayland=1", "Use Wayland", "Fixes rendering and input on Wayland. Disable if you use X11.", "Compatibility"),
    ("sdl_videodriver=wayland", "SDL on Wayland", "Tells older SDL games to use Wayland. Fixes mouse and fullscreen.", "Compatibility"),
    ("sdl_videodriver=x11", "Force X11 (SDL)", "Fallback if Wayland causes issues. May fix mouse lock problems.", "Compatibility"),
    ("gamescope", "Gamescope wrapper", "Micro-compositor that fixes alt-tab, scaling, and HDR. Useful on multi-monitor.", "Compatibility"),
    ("proton experimental", "Proton Experimental", "Bleeding-edge Proton with latest fixes. Try if stable Proton fails.", "Compatibility"),
    ("proton ge", "Proton GE", "Community build with extra media codecs and patches. Better game compatibility.", "Compatibility"),
    ("winedlloverrides", "Wine DLL override", "Replaces Windows DLLs with native versions. Fixes specific game bugs.", "Compatibility"),
    ("gamemoderun", "GameMode", "Tells your system to prioritize game performance over background tasks.", "Performance"),
    ("game-performance", "CPU performance", "Sets CPU scheduler to performance mode for this game.", "Performance"),
    ("mangohud", "MangoHUD overlay", "Shows FPS, GPU/CPU usage, and temps in-game. Useful for tuning.", "Performance"),
    ("proton_use_ntsync=1", "NTSync (faster)", "Kernel-level Windows sync. Reduces stutter on Linux 6.14+. Requires new kernel.", "Performance"),
    ("dxvk_async=1", "Async shaders", "Compiles shaders in background to reduce stutter. May cause visual glitches.", "Performance"),
    ("dxvk_frame_rate", "Frame rate cap", "Limits FPS to reduce heat, fan noise, or screen tearing.", "Performance"),
    ("proton_fsr4_upgrade=1", "FSR4 upgrade", "Replaces older FSR/DLSS with FSR4. Better upscaling quality on modern GPUs.", "Performance"),
    ("proton_enable_nvapi=1", "Enable DLSS / Reflex", "Enables NVIDIA DLSS, Reflex, and Frame Gen. Requires NVIDIA GPU.", "NVIDIA"),
    ("prime-run", "NVIDIA Prime", "Runs game on dedicated NVIDIA GPU on dual-GPU laptops.", "NVIDIA"),
    ("__gl_shader_disk_cache", "Shader cache size", "Increases shader cache to reduce stutter. Good for large open-world games.", "Performance"),
    ("proton_enable_hdr=1", "Enable HDR", "Enables HDR output. Requires HDR monitor and Wayland.", "Display"),
    ("dxvk_hdr=1", "DXVK HDR", "HDR support via DXVK translation layer.", "Display"),
    ("enable_hdr_wsi=1", "HDR window system", "Enables HDR at the window system level. Required for full HDR pipeline.", "Display"),
    ("nostartupmovies", "Skip intro videos", "Skips splash screens and logos when launching the game.", "QoL"),
    ("nomoviestartup", "Skip intro videos", "Skips startup movies to get into the game faster.", "QoL"),
    ("skip.*intro", "Skip intros", "Skips intro sequences on game launch.", "QoL"),
    ("disabl.*launcher", "Disable launcher", "Skips the game's own launcher window. Goes straight to the game.", "QoL"),
    ("proton_log=1", "Proton debug log", "Creates detailed Proton logs. Only enable when troubleshooting.", "Debug"),
    ("proton_enable_nvapi=0", "Disable DLSS/Reflex", "Turns off DLSS and Reflex. Try if you get crashes with them on.", "Compatibility"),
    ("black screen", "Black screen fix", "Common issue. Try Gamescope or switch between Wayland/X11.", "Fix"),
    ("windowed mode", "Windowed mode", "Run in window instead of fullscreen. May fix alt-tab issues.", "Fix"),
    ("no tweaks required", "Works out of the box", "Game runs without any special configuration needed.", "Info"),
    ("works out of the box", "Works out of the box", "No special configuration needed. Just install and play.", "Info"),
)
