"""Word lists, patterns and names that results depend on."""

ABBREVIATIONS = (("nđ", "nghị định"), ("tt", "thông tư"), ("qđ", "quyết định"), ("cp", "chính phủ"), ("blhs", "bộ luật hình sự"), ("blds", "bộ luật dân sự"), ("bllđ", "bộ luật lao động"), ("blttds", "bộ luật tố tụng dân sự"), ("bltths", "bộ luật tố tụng hình sự"), ("xphc", "xử phạt hành chính"), ("vbpl", "văn bản pháp luật"), ("qh", "quốc hội"), ("ttcp", "thủ tướng chính phủ"), ("ubnd", "ủy ban nhân dân"), ("hđnd", "hội đồng nhân dân"))
IDENTITY = ("bạn là ai", "bạn là gì", "mày là ai", "who are you", "bạn tên gì", "tên bạn là gì", "bạn là chatbot gì")
SOCIAL = ("xin chào", "hello", "hi", "chào", "cảm ơn", "thanks", "thank you", "tạm biệt", "bye", "ok", "được", "vâng", "dạ", "ừ", "oke")
GREETING = ("xin chào", "hello", "cảm ơn", "tạm biệt")
COMPARATIVE = ("so sánh", "khác biệt", "giống nhau", "vs")
PROCEDURAL = ("cách", "làm sao", "thế nào", "quy trình", "hướng dẫn")
ANSWER_PROCEDURAL = ("làm thế nào", "hướng dẫn", "cách", "thủ tục", "quy trình")
ANSWER_COMPARATIVE = ("so sánh", "khác nhau", "giống", "phân biệt")
TRIVIAL = ("xin chào", "hello", "cảm ơn", "tạm biệt", "ok")
COMPLEX = ("so sánh", "phân tích", "đánh giá", "quy trình chi tiết", "hướng dẫn", "các bước", "làm thế nào", "khác biệt")
RELATIONSHIP = ("mối quan hệ", "quan hệ", "liên quan", "liên kết", "kết nối", "ảnh hưởng", "tác động", "phụ thuộc", "dẫn đến", "gây ra", "bắt nguồn từ")
REGULATION = ("khoản", "mục", "chương", "quy chế", "nghị định", "thông tư")
REGULATION_QUESTION = ("điều kiện", "yêu cầu", "quy định", "thủ tục", "hồ sơ", "chế tài", "hình phạt", "mức phạt", "xử phạt", "hành vi", "vi phạm", "nghĩa vụ", "quyền", "trách nhiệm", "thẩm quyền", "hiệu lực", "cấm", "bị cấm", "không được phép")
MULTI_HOP = (r"nếu.*vi phạm.*thì.*bị", r"nếu.*không.*tuân thủ.*thì", r"hành vi.*bị.*xử phạt.*như thế nào", r"mối quan hệ.*giữa.*luật.*và.*nghị định", r"nghị định.*hướng dẫn.*luật", r"thông tư.*hướng dẫn.*nghị định", r"từ.*vi phạm.*đến.*chế tài", r"ảnh hưởng.*như thế nào", r"tác động.*đến", r"dẫn chiếu.*đến", r"liên quan.*đến.*điều")
RELATION_SCAN = (r"liệt kê.*(có|với).*(quan hệ|mối quan hệ).*(yeu_cau|quy_dinh|điều kiện)", r"(các điều|điều khoản).*(có|với).*(quan hệ|relationship)", r"scan.*relationship", r"tìm.*(các cặp|cặp).*(có|với).*quan hệ")
GLOBAL = (r"so sánh.*(luật|nghị định|thông tư|quy định)", r"khác biệt.*(giữa|của).*(luật|nghị định|phiên bản)", r"tóm tắt.*(quy định|luật|nghị định|thông tư)", r"tổng quan.*(về|của)", r"liệt kê tất cả.*(điều|khoản|quy định|chế tài)", r"có bao nhiêu (điều|khoản|quy định|hành vi)", r"phân loại.*(vi phạm|chế tài|hành vi)", r"nhóm.*(vi phạm|quy định)", r"các loại.*(hình phạt|chế tài|vi phạm)")
KEYWORD_STOP = ("là", "của", "và", "có", "trong", "với", "để", "về", "tại", "từ", "này", "đó", "những", "các", "một", "như", "được", "sẽ", "đã", "đang", "thì", "nếu", "khi", "mà", "hay", "hoặc", "gì", "nào")
FILLER = ("luật", "theo", "trong", "của", "và", "hoặc", "về", "quy", "định", "nói", "gì", "như", "thế", "nào", "hỏi", "cho", "xin", "được", "có", "là")
DOMAINS = (("hình_sự", ("hình sự", "tội phạm", "hình phạt", "blhs")), ("dân_sự", ("dân sự", "hợp đồng", "bồi thường", "blds")), ("hành_chính", ("hành chính", "xử phạt", "vi phạm hành chính", "xphc")), ("lao_động", ("lao động", "người lao động", "người sử dụng lao động", "bllđ")), ("thương_mại", ("thương mại", "doanh nghiệp", "kinh doanh")), ("giao_thông", ("giao thông", "đường bộ", "phương tiện")), ("đất_đai", ("đất đai", "quyền sử dụng đất", "bất động sản")), ("thuế", ("thuế", "thuế thu nhập", "thuế giá trị gia tăng")))
DOC_TYPES = (("luật", ("luật", "bộ luật")), ("nghị_định", ("nghị định", "nđ")), ("thông_tư", ("thông tư", "tt")), ("quyết_định", ("quyết định", "qđ")), ("nghị_quyết", ("nghị quyết",)))
COMPARISON_CUES = (r"(?:so\s+sánh|khác\s+(?:nhau|gì)|giống\s+nhau)", r"(?:và|với)\s+điều\s+[0-9]+")
DEFINITION_CUES = (r"^[^đ]*(?:là\s+)?gì\s*\??$", r"định\s+nghĩa", r"giải\s+thích\s+(?:từ\s+)?(?:ngữ)?", r"có\s+nghĩa\s+là", r"được\s+hiểu\s+(?:là|như)")
QUESTION_CUES = (r"^(?:hỏi|cho\s+hỏi|xin\s+hỏi)", r"(?:như\s+thế\s+nào|ra\s+sao|thế\s+nào)\s*\??$", r"(?:có\s+)?(?:quy\s+định|nói|đề\s+cập)(?:\s+gì)?(?:\s+về)?", r"(?:khi\s+nào|bao\s+giờ|ở\s+đâu)", r"(?:ai|những\s+ai|đối\s+tượng\s+nào)")
#: On lower-cased text.
LAW_NUMBER = r"([0-9]+)\s*[/\-]\s*([0-9]{4})\s*[/\-]?\s*(qh[0-9]*|nđ[-\s]?cp|tt[-\s]?[a-z]*|bldtbxh)?"
ARTICLE, CLAUSE, CLAUSE_SHORT, POINT = r"điều\s+(?:số\s+)?([0-9]+[a-zà-ỹ]*)", r"khoản\s+([0-9]+)", r"k\.?\s*([0-9]+)(?:\s*điều|\s*$)", r"điểm\s+([a-zđ])"
BOILERPLATE = (r"^\s*quốc\s*hội\s*$", r"^\s*cộng\s*hòa\s*xã\s*hội\s*chủ\s*nghĩa\s*việt\s*nam\s*$", r"^\s*độc\s*lập.*tự\s*do.*hạnh\s*phúc\s*$", r"^\s*-{3,}\s*$", r"^\s*_{3,}\s*$", r"^\s*trang\s*[0-9]+\s*$", r"^\s*[0-9]+\s*/\s*[0-9]+\s*$")
ANALYZER_STOP = ("của", "và", "trong", "với", "đã", "được", "có", "là", "từ", "cho", "về", "theo", "như", "khi", "nếu", "để", "sẽ", "đến", "tại", "các", "những", "một", "này", "đó", "không", "hoặc")
#: Vietnamese letters by the plain letter they fold to.
FOLDED = (("a", "àáảãạăằắẳẵặâầấẩẫậ"), ("d", "đ"), ("e", "èéẻẽẹêềếểễệ"), ("i", "ìíỉĩị"), ("o", "òóỏõọôồốổỗộơờớởỡợ"), ("u", "ùúủũụưừứửữự"), ("y", "ỳýỷỹỵ"))
LAW_ID = r"([0-9]+)[/\-]([0-9]{4})[/\-]?(QH[0-9]*|NĐ[-\s]?CP|TT[-\s]?[A-Z]*)?"
LAW_NAMES = ((r"^\s*luật\s+(.+)$", "Luật"), (r"^\s*nghị\s*định\s+(.+)$", "Nghị định"), (r"^\s*thông\s*tư\s+(.+)$", "Thông tư"))
DOC_KINDS = (("LAW", r"(?m)^\s*luật\s*$|qh[0-9]*"), ("DECREE", r"(?m)^\s*nghị\s*định\s*$|nđ[-\s]?cp"), ("CIRCULAR", r"(?m)^\s*thông\s*tư\s*$|tt[-\s]?[a-z]+"))
#: Headings, on one trimmed line.
HEADINGS = (("CHUONG", r"^(?:chương)\s+([ivxlcdm]+)\.?\s*(.*)$"), ("MUC", r"^(?:mục)\s+([0-9]+)\.?\s*(.*)$"), ("DIEU", r"^(?:điều)\s+([0-9]+[a-z]?)\.?\s*(.*)$"), ("KHOAN", r"^([0-9]{1,2})\.\s+(.*)$"), ("DIEM", r"^([a-zđăâêôơư])\)\s+(.*)$"))
DEFINITION = r"giải\s+thích\s+từ\s+ngữ|trong\s+(?:luật|nghị\s+định|thông\s+tư)\s+này.*hiểu\s+như\s+sau|định\s+nghĩa"
VIETNAMESE = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
AMENDING = r"sửa đổi|bổ sung|cập nhật|thay thế|điều chỉnh"
TRUNCATED = (r",\s*$", r"tại\s+[Kk]hoản\s*$", r"tại\s+[Đđ]iều\s*$", r"theo\s+[Qq]uy\s+định\s*$", r"như\s+sau\s*:\s*$", r"bao\s+gồm\s*:\s*$", r"[;:]\s*$", r"\.\.\.\s*$", r"và\s*$", r"hoặc\s*$", r"gồm\s*$", r"có\s*$", r"là\s*$", r"được\s*$", r"phải\s*$")
ROMAN = (("i", 1), ("ii", 2), ("iii", 3), ("iv", 4), ("v", 5), ("vi", 6), ("vii", 7), ("viii", 8), ("ix", 9), ("x", 10))
ID_PREFIXES = ("MON_HOC_", "KHOA_", "NGANH_", "QUY_DINH_", "DIEU_KIEN_")
LEGAL_TERMS = ("luật", "nghị định", "thông tư", "quy định", "điều", "khoản")
ASPECTS = ("đầu tiên", "thứ hai", "cuối cùng", "ngoài ra", "bên cạnh đó")
AMENDING_ARTICLE = ("cập nhật", "sửa đổi", "bổ sung", "như sau")
#: First and last article of each chapter.
CHAPTER_RANGES = ((1, 1, 9), (2, 10, 19), (3, 20, 27), (4, 28, 30), (5, 31, 34), (6, 35, None))
TOPICS = (("học phí", ("học phí", "mức phí", "thanh toán", "hphk", "đóng phí", "học bổng")), ("chương trình đào tạo", ("chương trình đào tạo", "học phần", "tín chỉ", "khung chương trình")), ("tuyển sinh", ("tuyển sinh", "xét tuyển", "đăng ký xét tuyển", "hồ sơ tuyển sinh")), ("tốt nghiệp", ("tốt nghiệp", "xét tốt nghiệp", "bằng tốt nghiệp", "bảo vệ luận văn")), ("điểm số", ("điểm", "thang điểm", "điểm chữ", "điểm số", "điểm trung bình")), ("học tập", ("học tập", "sinh viên", "người học", "kết quả học tập")))
#: The first cue that a question contains, in this order, gives its answer type and its intent.
ANSWER_CUES = (("bao nhiêu", "amount_range"), ("mức phạt", "amount_range"), ("phạt bao nhiêu", "amount_range"), ("tiền phạt", "amount_range"), ("có được", "boolean"), ("có phải", "boolean"), ("có bị", "boolean"), ("đúng hay sai", "boolean"), ("điều nào", "article_ref"), ("khoản nào", "article_ref"), ("theo điều", "article_ref"), ("định nghĩa", "definition"), ("là gì", "definition"), ("nghĩa là gì", "definition"), ("thủ tục", "procedure"), ("trình tự", "procedure"), ("hồ sơ", "procedure"), ("hiệu lực", "temporal"), ("khi nào", "temporal"), ("từ ngày", "temporal"), ("so sánh", "comparison"), ("khác nhau", "comparison"))
INTENT_CUES = (("phạt", "sanction_lookup"), ("mức phạt", "sanction_lookup"), ("bị xử phạt", "sanction_lookup"), ("chế tài", "sanction_lookup"), ("điều", "article_lookup"), ("khoản", "article_lookup"), ("định nghĩa", "definition_lookup"), ("là gì", "definition_lookup"), ("cấm", "prohibition_check"), ("nghiêm cấm", "prohibition_check"), ("hành vi bị cấm", "prohibition_check"), ("quyền", "right_obligation"), ("nghĩa vụ", "right_obligation"), ("trách nhiệm", "right_obligation"), ("thủ tục", "procedure_lookup"), ("trình tự", "procedure_lookup"), ("hiệu lực", "validity_check"), ("còn hiệu lực", "validity_check"))
SCOPE_DOCUMENT, SCOPE_ARTICLE = r"((?:Luật|Nghị định|Thông tư|Quyết định)\s+[0-9A-Za-zÀ-ỹĐđ_/\-]+)", r"((?:Điều|Khoản|Điểm)\s+[0-9]+[0-9A-Za-zÀ-ỹĐđ_]*)"
#: Edge types by the extracted relation.
EDGE_TYPES = (("THUOC_VE", "THUOC_VE"), ("SUA_DOI", "SUA_DOI"), ("BO_SUNG", "BO_SUNG"), ("THAY_THE", "THAY_THE"), ("BAI_BO", "BAI_BO"), ("THAM_CHIEU", "THAM_CHIEU"), ("VIEN_DAN", "VIEN_DAN"), ("DINH_NGHIA", "DINH_NGHIA"), ("YEU_CAU", "YEU_CAU"), ("AP_DUNG", "AP_DUNG"), ("LIEN_QUAN", "LIEN_QUAN"), ("LIEN_QUAN_NOI_DUNG", "LIEN_QUAN"), ("QUY_DINH_DIEU_KIEN", "QUY_DINH"), ("AP_DUNG_CHO", "AP_DUNG"), ("DAT_DIEM", "LIEN_QUAN"), ("TUONG_DUONG", "DONG_NGHIA"), ("MIEN_GIAM", "LIEN_QUAN"), ("GIOI_HAN", "RANG_BUOC"), ("DIEU_KIEN_TIEN_QUYET", "YEU_CAU"), ("THUOC_KHOA", "THUOC_VE"), ("CUA_NGANH", "THUOC_VE"), ("THUOC_CHUONG_TRINH", "THUOC_VE"))
AMENDMENT_TYPES = (("thay thế", "THAY_THE"), ("sửa đổi", "SUA_DOI"), ("bổ sung", "BO_SUNG"), ("bãi bỏ", "BAI_BO"))
COMPLETION = ("đủ thông tin", "có thể trả lời", "kết luận", "tóm lại", "như vậy", "câu trả lời")
#: Words of a graph query that show that it returns amounts, truth values, definitions, and what is in force.
AMOUNT_FIELDS = ("AMOUNT", "PENALTY", "MỨC", "CHẾ TÀI", "PHẠT")
BOOLEAN_FIELDS = ("EXISTS", "COUNT", "CASE WHEN")
DEFINITION_FIELDS = ("KHÁI NIỆM", "THUẬT NGỮ", "DINH_NGHIA", "DEFINITION")
VALIDITY_FIELDS = ("EFFECTIVE_DATE", "STATUS", "THAY_THE", "BAI_BO", "SUA_DOI", "HIEU_LUC", "CÒN HIỆU LỰC")
#: A label that a question about prohibitions needs, and the one that must not stand in its place.
POLARITY = (("Hành vi cấm", "Hành vi được phép"), ("Quyền", "Nghĩa vụ"), ("Chế tài", "Khái niệm"))
WRITES = r"\b(CREATE|DELETE|DETACH\s+DELETE|SET|REMOVE|MERGE)\b"
REVOKED = ("hết hiệu lực", "bị bãi bỏ", "bị thay thế")
#: A label's own keys of id and name; the label whose credits have a default, their key; the status of a document by default.
LABEL_KEYS = (("MON_HOC", "ma_mon", "ten_mon"), ("KHOA", "ma_khoa", "ten_khoa"), ("NGANH", "ma_nganh", "ten_nganh"), ("QUY_DINH", "ma_quy_dinh", "tieu_de"), ("DIEU_KIEN", "ma_dieu_kien", "mo_ta"))
COURSE, CREDITS, IN_FORCE = "MON_HOC", "so_tin_chi", "Còn hiệu lực"
