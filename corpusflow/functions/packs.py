"""Pattern and word tables as data: the Vietnamese packs and a small pack for the synthetic test tables."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    """Ordered (label, patterns) groups; the first group that matches wins."""

    safety: tuple[tuple[str, tuple[str, ...]], ...]
    messages: dict[str, str]
    audience: tuple[tuple[str, tuple[str, ...]], ...]
    condition: tuple[tuple[str, tuple[str, ...]], ...]
    intent: tuple[tuple[str, tuple[str, ...]], ...]
    aliases: tuple[tuple[str, str], ...]
    asr_fixes: tuple[tuple[str, str], ...]
    injection: tuple[str, ...]
    unsafe_claims: tuple[str, ...]
    disclaimer: str
    references: tuple[str, ...]
    toc_heading: str
    bylines: tuple[str, ...]
    navigation: tuple[str, ...]
    digits: dict[str, str] = field(default_factory=dict)


# fixed values: the Vietnamese word lists, in matching order
VI_DEFAULT = Pack(
    safety=(
        ("medical_emergency", ("khó thở", "đau ngực", "ngất", "co giật", "đột quỵ", "tai biến", "xuất huyết", "nôn ra máu", "tự tử", "tự hại")),
        ("clinical_decision", ("kê đơn", "uống thuốc gì", "liều thuốc", "tăng liều", "giảm liều", "ngừng thuốc", "chẩn đoán", "tôi bị bệnh gì", "kết quả xét nghiệm")),
        ("out_of_scope", ("đầu tư", "chứng khoán", "tiền ảo", "viết code", "lập trình")),
    ),
    messages={
        "empty_query": "Tôi chưa nghe rõ câu hỏi của bạn.",
        "medical_emergency": "Bạn nên liên hệ cấp cứu hoặc đến cơ sở y tế gần nhất ngay.",
        "clinical_decision": "Bạn nên trao đổi trực tiếp với bác sĩ hoặc chuyên gia dinh dưỡng.",
        "out_of_scope": "Hệ thống này chỉ hỗ trợ các câu hỏi về dinh dưỡng và chế độ ăn.",
        "normal": "",
    },
    audience=(
        ("pregnant", ("mang thai", "thai phụ", "bà bầu", "mẹ bầu")),
        ("breastfeeding", ("cho con bú", "mẹ sau sinh")),
        ("infant", ("trẻ sơ sinh", "dưới 1 tuổi", "ăn dặm")),
        ("child", ("trẻ em", "trẻ nhỏ", "bé", "con tôi")),
        ("elderly", ("người cao tuổi", "người già")),
    ),
    condition=(
        ("diabetes_type_1", ("đái tháo đường (?:týp|type) 1", "tiểu đường (?:týp|type) 1")),
        ("diabetes_type_2", ("đái tháo đường (?:týp|type) 2", "tiểu đường (?:týp|type) 2")),
        ("diabetes", ("đái tháo đường", "tiểu đường")),
        ("hypertension", ("tăng huyết áp", "huyết áp cao")),
        ("obesity", ("béo phì", "thừa cân")),
        ("pregnancy", ("mang thai", "thai kỳ")),
        ("kidney", ("bệnh thận", "suy thận")),
        ("cardiovascular", ("tim mạch", "cholesterol")),
        ("stomach", ("dạ dày", "trào ngược")),
    ),
    intent=(
        ("avoid_foods", ("kiêng", "không nên ăn", "tránh", "có ăn được")),
        ("recommended_foods", ("nên ăn gì", "ăn gì", "lựa chọn thực phẩm", "thực phẩm nào")),
        ("dosage", ("bao nhiêu", "liều lượng", "khẩu phần", "mỗi ngày")),
        ("benefits", ("tác dụng", "lợi ích", "có tốt không")),
        ("deficiency", ("thiếu", "bổ sung")),
        ("meal_plan", ("thực đơn", "chế độ ăn", "ăn uống thế nào", "ăn ra sao")),
    ),
    aliases=(
        ("bà bầu", "phụ nữ mang thai"),
        ("mẹ bầu", "phụ nữ mang thai"),
        ("thai phụ", "phụ nữ mang thai"),
        ("cho con bú", "bà mẹ cho con bú"),
        ("trẻ sơ sinh", "trẻ dưới 6 tháng tuổi"),
        ("trẻ nhỏ", "trẻ em dưới 5 tuổi"),
        ("người già", "người cao tuổi"),
        ("tiểu đường", "đái tháo đường"),
        ("đái tháo đường type 2", "đái tháo đường týp 2"),
        ("huyết áp cao", "tăng huyết áp"),
        ("tim mạch", "bệnh tim mạch"),
        ("béo phì", "thừa cân béo phì"),
        ("ung thư", "bệnh ung thư"),
        ("xương khớp", "bệnh cơ xương khớp"),
        ("dạ dày", "bệnh dạ dày"),
        ("vitamin C", "vitamin C axit ascorbic"),
        ("vitamin D", "vitamin D calciferol"),
        ("vitamin B12", "vitamin B12 cobalamin"),
        ("omega 3", "axit béo omega-3"),
        ("DHA", "DHA axit docosahexaenoic"),
        ("canxi", "canxi calcium"),
        ("sắt", "sắt iron khoáng chất"),
        ("protein", "protein chất đạm"),
        ("chất xơ", "chất xơ dietary fiber"),
        ("ăn chay", "chế độ ăn chay thuần thực vật"),
        ("ăn kiêng", "chế độ ăn kiêng giảm cân"),
        ("low carb", "chế độ ăn ít carbohydrate"),
        ("keto", "chế độ ăn ketogenic"),
        ("ăn dặm", "ăn dặm bổ sung cho trẻ"),
    ),
    asr_fixes=(
        ("omega ba", "omega 3"),
        ("omega- ba", "omega 3"),
        ("can xi", "canxi"),
        ("tiểu đường type hai", "tiểu đường type 2"),
        ("đái tháo đường type hai", "đái tháo đường type 2"),
        ("vitamin dê", "vitamin d"),
        ("vitamin đê", "vitamin d"),
        ("vitamin xê", "vitamin c"),
    ),
    injection=(r"ignore\s+(?:all\s+)?previous\s+instructions", r"bỏ qua\s+(?:tất cả\s+)?(?:hướng dẫn|chỉ dẫn)\s+trước", r"system\s+prompt", r"developer\s+message", r"hãy\s+đóng\s+vai"),
    unsafe_claims=("ngừng thuốc", "tăng liều", "giảm liều", "chắc chắn chữa khỏi", "khỏi hoàn toàn"),
    disclaimer="Để được tư vấn chính xác, bạn nên gặp bác sĩ dinh dưỡng.",
    references=("TÀI LIỆU THAM KHẢO", "NGUỒN THAM KHẢO", "REFERENCES?"),
    toc_heading="NỘI DUNG",
    bylines=("Bài viết được (?:cố vấn|tư vấn|kiểm duyệt)", "Nội dung video được tư vấn", r"Tác giả\s*:", r"Nguồn\s*:", r"Theo\s+\w+\.{0,3}com"),
    navigation=("Đăng nhập", "Đăng ký", "Trang chủ", "Liên hệ", "Hotline", "Copyright", "Facebook", "Zalo", "Youtube", "Instagram", "Twitter", "Sitemap"),
    digits={"0": "KHÔNG", "1": "MỘT", "2": "HAI", "3": "BA", "4": "BỐN", "5": "NĂM", "6": "SÁU", "7": "BẢY", "8": "TÁM", "9": "CHÍN"},
)

#: Chosen so that the rules fire on the invented words of the test tables.
TEST_EN = Pack(
    safety=(("medical_emergency", ("heat", "ingst")), ("clinical_decision", ("was", "der die")), ("out_of_scope", ("from", "avec", "para"))),
    messages={"empty_query": "say it again", "medical_emergency": "call for help", "clinical_decision": "ask a doctor", "out_of_scope": "only food here", "normal": ""},
    audience=(("child", ("are", "des")), ("elderly", ("this", "von")), ("pregnant", ("by",))),
    condition=(("diabetes_type_1", ("of the", "de la")), ("diabetes", ("of", "de")), ("stomach", ("and",))),
    intent=(("avoid_foods", ("not", "pas")), ("dosage", ("with", "pour")), ("benefits", ("that",))),
    aliases=(("the", "THE article"), ("article on", "upon"), ("ion", "ION"), ("que", "what"), ("der", "the")),
    asr_fixes=(("tion", "shun"), ("eau", "oh")),
    injection=(r"ignore\s+(?:all\s+)?previous\s+instructions", r"system\s+prompt"),
    unsafe_claims=("stop the medicine", "surely cured"),
    disclaimer="Ask a dietitian for exact advice.",
    references=("Bibliography", "References?"),
    toc_heading="CONTENTS",
    bylines=(r"Author\s*:", r"Source\s*:"),
    navigation=("Home", "Contact", "Sitemap"),
    digits={"0": "ZERO", "1": "ONE", "2": "TWO", "3": "THREE", "4": "FOUR", "5": "FIVE", "6": "SIX", "7": "SEVEN", "8": "EIGHT", "9": "NINE"},
)
