"""Keyword lists; all are defaults of parameters."""

# Terms that make a text relevant.
RELEVANT = [
    "ai", "a.i.", "人工智能", "大模型", "llm", "gpt", "claude", "openai", "anthropic", "gemini", "deepseek", "chatbot", "agent", "prompt", "模型", "算法", "训练", "推理", "生成",
    "midjourney", "mj", "stable diffusion", "sd", "sdxl", "comfyui", "flux", "krea", "dall-e", "dalle", "leonardo", "firefly", "ideogram", "playground", "lora", "controlnet", "nijijourney", "synthography",
    "aiart", "aiartcommunity", "aiartist", "generativeart", "promptshare", "aigeneratedart",
    "ai绘画", "ai绘图", "ai生图", "ai头像", "ai壁纸", "ai海报", "文生图", "图生图", "ai写真", "ai换脸", "治愈系插画", "国潮插画", "妙鸭", "此刻", "trik",
    "runway", "gen-3", "gen3", "sora", "veo", "veo3", "pika", "luma", "haiper", "hailuo", "minimax", "ray2", "stability video", "aivideo", "videogeneration", "textovideo",
    "kling", "可灵", "即梦", "海螺", "pixverse", "混元视频", "ai视频", "ai生成视频", "文生视频", "图生视频", "ai动画", "ai短片", "ai特效", "一键生成视频",
    "cursor", "claude code", "vibe coding", "copilot", "codex", "replit", "windsurf", "aider", "codeium", "tabnine", "v0", "bolt", "lovable", "devin", "continue", "cody",
    "vibecoding", "aicoding", "aicode", "codingwithai", "marscode", "通义灵码", "codegeex", "ai编程", "ai写代码", "ai开发", "ai工程师", "一人公司", "ai超级个体", "独立开发者", "零代码",
]

# Categories, in the order of first match.
IMAGE, VIDEO, CODING = "Image Gen", "Video Gen", "Vibe Coding"
FIRST_MATCH = {
    IMAGE: [
        "image", "img", "photo", "picture", "图", "图片", "绘画", "生图", "海报", "头像", "壁纸", "写真", "midjourney", "mj", "stable diffusion", "sd", "sdxl", "comfyui", "flux", "krea", "dall-e", "dalle",
        "leonardo", "firefly", "ideogram", "playground", "lora", "controlnet", "prompt", "风格化", "修图", "上色", "nijijourney", "synthography", "aiart", "aiartcommunity", "aiartist", "generativeart",
        "promptshare", "aigeneratedart", "midjourneyart", "midjourneyai", "stablediffusionart", "ai绘画", "ai绘图", "ai生图", "ai头像", "ai壁纸", "ai海报", "文生图", "图生图", "ai写真", "ai换脸",
        "治愈系插画", "国潮插画", "妙鸭", "此刻", "trik", "莫兰迪色",
    ],
    VIDEO: [
        "video", "视频", "animation", "动画", "短片", "剪辑", "镜头", "特效", "runway", "runwaygen3", "runwayml", "gen-3", "gen3", "sora", "openaisora", "veo", "veo3", "pika", "pikalabs", "luma", "lumadream",
        "haiper", "hailuo", "minimax", "ray2", "stability video", "aivideo", "videogeneration", "textovideo", "klingai", "kling", "可灵", "即梦", "海螺", "pixverse", "混元视频", "ai视频", "ai生成视频",
        "文生视频", "图生视频", "ai动画", "ai短片", "ai特效", "一键生成视频",
    ],
    CODING: [
        "code", "coding", "程序", "编程", "开发", "工程", "repo", "github", "git", "cursor", "cursorai", "claude code", "vibe coding", "copilot", "githubcopilot", "codex", "openaicodex", "replit", "replitagent",
        "windsurf", "aider", "codeium", "tabnine", "v0", "v0dev", "bolt", "lovable", "devin", "continue", "cody", "vibecoding", "aicoding", "aicode", "codingwithai", "marscode", "通义灵码", "codegeex", "vscode",
        "ide", "terminal", "cli", "agent", "workflow", "自动化", "前端", "后端", "python", "node", "typescript", "react", "prompt engineering", "ai编程", "ai写代码", "ai开发", "ai工程师", "一人公司",
        "ai超级个体", "独立开发者", "零代码",
    ],
}

# Terms that are counted for the category by score.
SCORED = {
    IMAGE: ["image", "img", "photo", "picture", "图", "图片", "绘画", "生图", "海报", "头像", "midjourney", "mj", "stable diffusion", "sd", "comfyui", "flux", "krea", "lora", "controlnet", "upscale", "magnific", "dalle", "ideogram"],
    VIDEO: ["video", "视频", "animation", "动画", "短片", "剪辑", "镜头", "分镜", "runway", "gen-3", "gen3", "kling", "可灵", "pika", "sora", "veo", "luma", "hailuo"],
    CODING: [
        "code", "coding", "程序", "编程", "开发", "工程", "repo", "github", "git", "cursor", "claude code", "vibe coding", "vscode", "ide", "agent", "workflow", "自动化", "前端", "后端", "python", "node",
        "typescript", "react", "next.js",
    ],
}

# The quality lists where an owner has none.
POSITIVE = [
    "tutorial", "workflow", "tips", "how to", "step by step", "guide", "setup", "build", "prompt engineering", "use case", "demo", "walkthrough", "comparison", "review", "best practices", "toolchain", "deep dive",
    "release", "upgrade", "launch", "教程", "实操", "工作流", "技巧", "分享", "经验", "玩法", "用法", "攻略", "测评", "对比", "上手", "指南", "保姆级", "干货", "实战", "案例", "发布", "升级", "重大更新",
]
BLACKLIST = [
    "hiring", "giveaway", "breaking news", "subscribe", "follow me", "sponsored", "ad", "promotion", "discount", "coupon", "招聘", "抽奖", "转发抽", "广告", "优惠", "打折", "求职", "招人",
]
