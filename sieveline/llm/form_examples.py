"""Inspected examples: (form, kind, text), labelled by hand.

All content is invented; some whole texts and many lines are rows of the given test tables, where they were inspected. No
measured figure is taken on them.
"""

_STORY = (
    "Cơ quan chức năng xã Lam Đồi đã nhận 21 đơn trình báo cùng nhắc đến Kavopimu. Một biến thể khác xuất hiện từ 8/10, trong đó kẻ xấu gọi điện "
    "lúc nửa đêm rồi tắt máy. Nạn nhân kể rằng họ rất sợ nên đã chuyển tiền ngay, sau đó mới biết là bị lừa."
)
_STORY2 = (
    "Bà H. ở thôn Mây Quế mất 35 triệu đồng vì tin lời một người tự xưng là nhân viên ngân hàng. Người này nói tài khoản của bà có giao dịch lạ và "
    "yêu cầu đọc mã xác thực. Khi bà hỏi lại, đối tượng đổi giọng, dọa phạt rồi tắt máy. Không có đơn vị nào tên Zukavilo đăng ký hoạt động tại đây."
)
_ENGLISH = (
    "The caller claimed that a parcel was held at the depot and that a fee had to be paid before noon. When questioned, the man became angry and hung "
    "up. I still have the receipt and a print of the page, which copied the colours of the bank but misspelled its name."
)
_SMS = "Thư viện xã Lạc Cầu nhắc bạn trả sách mã 963071 trước 13 giờ ngày 22/7. Nếu đã trả, vui lòng bỏ qua tin này."

EXAMPLES = [
    ("prose", "story", _STORY),
    ("prose", "story", _STORY2),
    ("prose", "story", _STORY + "\n\n" + _STORY2),
    ("prose", "story", _STORY2 + " " + _STORY + "\n" + _STORY2),
    ("prose", "english", _ENGLISH),
    ("prose", "english", _ENGLISH + "\n\nLater they wanted another 90,664 dong for a ticket. My cousin paid too and heard nothing. A shopkeeper noticed the trick because they never send links."),
    ("prose", "sms", _SMS),
    ("prose", "sms", "Hồ sơ 3754-C25 thiếu chữ ký, nộp bổ sung 99 nghìn tại lidanavo-qua.invalid/238 trước 3/7."),
    ("prose", "sms", "[Nefegiki] Thẻ 233928 của quý khách bị tạm dừng, vào qanuzu-hotro.example/49 xác nhận trước 12 giờ 6 ngày 20/2."),
    ("prose", "sms", "Mã xác thực của bạn là 482910, có hiệu lực trong 5 phút. Không đưa mã này cho bất kỳ ai."),
    ("prose", "sms_open", "Thư viện xã Lạc Cầu nhắc bạn trả sách mã 963071 trước 13 giờ 23 ngày 22/7"),
    ("prose", "sms_open", "Jirevipi giảm 30 phần trăm cho khách ở thôn Sim Trạch đến hết 14/4/2021 không cần mã"),
    ("prose", "sms_open", "thẻ 233928 của quý khách bị tạm dừng vào qanuzu-hotro.example/49 xác nhận trước 12 giờ 6 ngày 20/2"),
    ("prose", "sms_lines", "Hello, parcel BX33120 waits in huyện Tràm Mộc, pay 18,348 VND today to release it.\nHello, parcel VD10822 waits in thị trấn Giang Đậu, pay 71,356 VND today to release it.\nYou won 18,160 dong from Cipimozi, reply DV61006 within 57 minutes."),
    ("prose", "sms_lines", "Lệnh 539327 đã thắng 718 triệu, nạp thêm vào Jorafajo để mở khóa rút.\nĐơn 267161 của bạn dự kiến giao tại khu phố Chuối Gồ vào 13/11/2025, không cần trả thêm phí.\nHồ sơ thiếu chữ ký, nộp bổ sung 99 nghìn trước 3/7."),
    ("prose", "sms_open_lines", "Việc nhẹ tại nhà cùng Vodecobi mỗi ngày 518 triệu nhắn TB59248 để nhận nhiệm vụ\nThư viện thôn Cầu Lụa nhắc bạn trả sách mã 6065-G69 trước chiều 27/6\nLệnh DM67230 đã thắng 81 triệu nạp thêm vào Pokixura để mở khóa rút\nYou won 72,684 dong from Piqavera reply GL11169 within 75 minutes"),
    ("prose", "sms_open_lines", "Hello parcel 5244-V29 waits in phường Hoài Lam pay 70,973 dollars today to release it\nYour loan of 48,928 dong is approved send the fee to gavuqoki-the.invalid/3110-h38 before noon\nDear friend I met you on 12 January 2025 and my gift of 20,938 dollars is stuck in huyện Hối Hoài\nThis is the office of Zanudo your card is locked call us"),
    ("prose", "chat", "A: Em là Q. bên kho huyện Vân Thạch, kiện hàng đang chờ, anh gửi 420k qua số này giúp em.\nBạn: Người gọi xưng G., đọc đúng số trên giấy tờ của tôi.\nA: Họ bảo hồ sơ sắp hết hạn, phải vào trang này ngay.\nBạn: Để tôi hỏi lại ngân hàng đã."),
    ("prose", "chat", "Khách: Chào anh chị, em bên chi nhánh phường Hà Kén, đơn cần thanh toán trong hôm nay ạ.\nSố lạ: Hôm trước có người rao điện thoại cũ rồi chuyển khách sang trang khác để thanh toán, tôi nên báo ai?\nKhách: Em không rõ, chị gọi tổng đài giúp em."),
    ("prose", "chat_open", "B Tôi chuyển lần đầu 333,2 triệu đồng lần sau 491 nghìn đều vào số 554183\nKhách Hôm 29/3 có người trả thưởng cho nhiệm vụ thả tim đầu tiên sau đó giữ giấy tờ và đòi tiền chuộc tôi nên báo ai\nB Lần cuối họ dùng số khác tự nhận là người quen ở thị trấn Lũng Lụa\nKhách Em không biết nữa để em hỏi lại"),
    ("prose", "chat_open", "Mẹ Con ơi mẹ vừa nhận được tin nhắn nói là trúng thưởng có thật không\nCon Không có đâu mẹ đừng bấm vào đó kẻo mất tiền\nMẹ Nhưng họ đọc đúng tên mẹ và số nhà mình\nCon Họ mua thông tin ở đâu đó thôi mẹ cứ xóa đi"),
    ("prose", "open", _STORY.replace(".", "").replace(",", "")),
    ("prose", "open", _STORY2.replace(".", "").replace(",", "").lower()),
    ("prose", "open", _STORY.replace(".", "").replace(",", "") + "\n" + _STORY2.replace(".", "").replace(",", "")),
    ("prose", "capitals", _STORY.upper()),
    ("prose", "capitals", _STORY2.upper()),
    ("prose", "bare", "Ba H o thon May Que mat 35 trieu dong vi tin loi mot nguoi tu xung la nhan vien ngan hang. Nguoi nay noi tai khoan cua ba co giao dich la va yeu cau doc ma xac thuc. Khi ba hoi lai, doi tuong doi giong, doa phat roi tat may."),
    ("prose", "bare", "Co quan chuc nang da nhan 21 don trinh bao cung nhac den nhom nay. Mot bien the khac xuat hien tu 8/10, trong do ke xau goi dien luc nua dem roi tat may."),
    ("prose", "wrapped", "> Bà H. ở thôn Mây Quế mất 35 triệu   đồng vì\n> tin lời một người tự xưng là \tnhân viên\nngân hàng. Người này nói tài khoản của  bà có\n> giao dịch lạ và yêu cầu đọc mã   xác thực. Khi\nbà hỏi lại, đối tượng đổi giọng, dọa phạt rồi\n> tắt máy. Không có đơn vị nào tên như vậy."),
    ("prose", "wrapped", "The caller claimed that a parcel   was held\n> at the depot and that a fee had to be\npaid before noon. When  questioned, the man\n> became angry and hung up. I still have the\nreceipt and a print of the page."),
    ("prose", "with_list", _STORY + "\n" + _STORY2 + "\n- chặn số Bamogole\n- gỡ ứng dụng Fazabaxo\n- đổi mật khẩu Wipawaqo"),
    ("prose", "with_list", _STORY2 + "\n" + _STORY + "\n1. Hãy gọi lại tổng đài bằng số in trên thẻ.\n2. Không cài tệp lạ do người gọi gửi.\n3. Lưu lại ảnh màn hình để trình báo."),
    ("prose", "with_table", _STORY + "\n" + _STORY2 + "\n| ngày | số tiền |\n| 3/4 | 35 triệu |\n| 8/10 | 21 triệu |"),
    ("prose", "with_table", _STORY2 + " " + _STORY + "\nngày;loại;nguồn\n3/4;vay;21\n8/10;quà;35"),
    ("list", "bullets", "- chặn số Bamogole\n- gỡ ứng dụng Fazabaxo\n- lưu ảnh màn hình Rizuzalo\n- báo ngân hàng Wanuzaze\n- hỏi người thân Dajamada\n- đổi mật khẩu Wipawaqo\n- gỡ ứng dụng Macilixe"),
    ("list", "bullets", "Các mục cần kiểm tra:\n* huyện Rừng Vân (54 vụ)\n* xã Hoài Lam\n* xã Sim Bưởi (23 vụ)\n* khu phố Phèn Đậu (81 vụ)\n* thôn Nhạn Lạc\n* thị trấn Vân Chuối (6 vụ)\n* huyện Lụa Lũng"),
    ("list", "numbered", "1. khóa sim 226406\n2. hoàn tiền YY11705\n3. vay nóng 599968\n4. vay nóng 535962\n5. khóa sim 945911\n6. quà tặng 444226\n7. việc nhẹ CD61592\n8. tri ân PD67339"),
    ("list", "numbered", "1) Q. phường Hoài Diềm, 3.076.000 đồng\n2) M. phường Rạng Đậu, 113.003.000 đồng\n3) X. phường Rừng Hối, 972 nghìn\n4) G. thôn Hối Kén, 275k\n5) T. phường Bích Phèn, 872 triệu\n6) C. thôn Chuối Nhạn, 276 triệu"),
    ("list", "named", "+ K. huyện Rừng Cốc, 654.320.000 đồng\n+ B. huyện Bồng Mai, 7440k\n+ A. huyện Mộc Thạch, 799 nghìn\n+ B. thị trấn Lụa Chuối, 129.499.000 đồng\n+ M. khu phố Gồ Cốc, 765,8 triệu đồng"),
    ("list", "named", "H. phường Bích Bưởi, 269,5 triệu đồng\nB. huyện Quế Khê, 945.202.000 đồng\nM. thôn Ngải Hà, 910.108.000 đồng\nK. phường Mai Cốc, 737.711.000 đồng\nY. phường Khê Trạch, 804,2 triệu đồng\nK. thị trấn Phèn Phèn, 73.718.000 đồng"),
    ("list", "plain", "hỏi người thân Diqufeda\nbáo ngân hàng Vegududi\nchặn số Fogulira\nlưu ảnh màn hình Xaluwolu\nchặn số Peduxezo\ngỡ ứng dụng Gavanuzu\nđổi mật khẩu Kucuquze"),
    ("list", "plain", "Gonubibo - 0000 584514\nZobunapi - 0000 9259-D78\nXudoxube - 0000 389767\nLuzuwovo - 0000 807965\nXibejeka - 0000 CS66564\nGekubadi - 0000 6780-G69"),
    ("list", "plain", "lưu ảnh màn hình Vaviruxu\nhỏi người thân Kurowilu\nlưu ảnh màn hình Lazedere\nđổi mật khẩu Koboxuqa\nđổi mật khẩu Nupaqini\nkhóa thẻ Pujofipo\nbáo ngân hàng Bebugagi\nkhóa thẻ Nazoqepo"),
    ("list", "plain", "Tổng hợp:\nkhóa thẻ Fejuvonu\nlưu ảnh màn hình Xuxopape\nhỏi người thân Viluruga\nchặn số Fawowudu\nđổi mật khẩu Lufudeca\nbáo ngân hàng Qizizeqa"),
    ("list", "plain", "hoàn tiền DL27288\nviệc nhẹ 978077\nviệc nhẹ 5820-Y96\nquà tặng 3747-A25\nvay nóng 215487\ntri ân AX13292\nkhóa sim 5105-V96"),
    ("list", "places", "thị trấn Khê Lam\nhuyện Bưởi Trạch\nxã Nhạn Ngải (39 vụ)\nxã Ngải Tràm\nkhu phố Hà Quế (92 vụ)\nthị trấn Cầu Lụa\nhuyện Đậu Chuối\nthôn Châu Gồ"),
    ("list", "places", "Danh sách cập nhật dưới đây:\nhuyện Bưởi Lụa (90 vụ)\nthị trấn Phèn Bồng (66 vụ)\nhuyện Hoài Châu\nhuyện Mộc Chuối (7 vụ)\nthôn Diềm Trạch\nhuyện Sậy Cốc (35 vụ)"),
    ("list", "headlines", "Đường dây Zoviloku bị phát hiện ở phường Rạng Châu\n60 signs that Kagapego is not real\nĐường dây Fidewaje bị phát hiện ở thị trấn Khê Bích\nChiêu mới tại thị trấn Lạc Hà: nói sim chưa chuẩn hóa nên bị khóa\nNhận diện trang kavopimu-hotro.test/471306 mạo danh"),
    ("list", "headlines", "54 điều cần nhớ khi gặp nhóm kín tín hiệu Wicacixo\nBà G. bán hàng ở khu phố Cốc Thạch kể lại phút bị lừa 662,9 triệu đồng\nCảnh báo Qajuquja giả thu tiền ở khu phố Cốc Chuối\nMất 3440k vì tin nhóm kín tín hiệu Dapulile\nHow a shopkeeper in xã Vân Lạc lost 63,786 VND\nCảnh báo Ruxugeve giả thu tiền ở huyện Khê Phèn"),
    ("list", "headlines", "Known names so far:\n- Mất 861,9 triệu đồng vì tin ứng dụng vay Xeruxafo\n- Cảnh báo Ruxugeve giả thu tiền ở huyện Khê Phèn\n- Chiêu mới tại xã Bích Trạch: duyệt khoản vay chỉ cần ảnh căn cước\n- 39 signs that Cuzikabi is not real\n- Cảnh báo Bujoqopi giả thu tiền ở khu phố Mây Lam\n- Bà Q. kể lại phút bị lừa 532 triệu đồng"),
    ("list", "links", "* https://qogozoqu-vay.test/tm94679\n* https://feliluwo-qua.example/qd84581\n* https://jiropuci-the.test/787260\n* https://babalupo-vay.test/mk52283\n* https://zomefivu-qua.test/877738"),
    ("list", "links", "☑ https://biwefipi-xacminh.test/440492\n☑ https://gelebemi-vay.test/4131-s80\n☑ https://gogiluko-qua.test/ts30445\n☑ https://bomuwopo-qua.test/cq81846\n☑ https://runoxoxi-qua.invalid/tn24915"),
    ("list", "links", "1. https://kiqovexi-hotro.invalid/5880-s25\n2. https://jicicoru-vay.test/782013\n3. https://caforice-xacminh.test/185521\n4. https://lobijeku-hotro.invalid/473662\n5. https://kuweqiko-the.example/141437"),
    ("list", "run", "chặn số Copupaci, gỡ ứng dụng Picoxaxi, chặn số Bomukoko, hỏi người thân Napumoji, đổi mật khẩu Buganive, báo ngân hàng Zorivolo, lưu ảnh màn hình Gejagifa, đổi mật khẩu Czegezu"),
    ("list", "run", "Known names so far:\nviệc nhẹ 210352, việc nhẹ QL33866, hoàn tiền 756570, hoàn tiền 286751, fake parcel 922501, khóa sim AT63434, fake parcel 564509, tri ân AL57356, tri ân HC78265"),
    ("list", "run", "Các mục cần kiểm tra:\nkhóa thẻ Xivodive, lưu ảnh màn hình Wogebefi, khóa thẻ Zonirapo, gỡ ứng dụng Qemakizi, hỏi người thân Dubaconi, hỏi người thân Gogebabu, báo ngân hàng Bevoboxu"),
    ("table", "pipes", "| địa bàn | loại | case | nguồn |\n|---|---|---|---|\n| 327944 | 52 | Gegocuci | 38 |\n| 447944 | 96 | Qugugefe | 3 |\n| 8865-B62 | 71 | Xikopeji | 75 |\n| 9783-K65 | 8 | Jiwoqaki | 93 |"),
    ("table", "pipes", "loại | địa bàn | nguồn\nsáng 20/6 | 30 | MS60122\ntrưa 7/9 | 5 | 7389-Y29\n14 giờ 11 ngày 7/8 | 58 | HB73237\n23/11/2026 | 38 | 695682\ntối 6/9 | 24 | 926939"),
    ("table", "double", "case||loại||địa bàn\n455,4 triệu đồng||Dezumamu||23/12/2022\n923.440.000 đồng||Wulalomu||chiều 7/1\n2600k||Larobiwi||11 giờ 37 ngày 12/1\n763,1 triệu đồng||Buvogowa||trưa 26/8"),
    ("table", "double", "số tiền||amount||loại||tài khoản||ngày\n||tối 3/1||tối 28/7||Jepulavi||12 giờ 33 ngày 2/8\nchờ||trưa 14/9||8/3/2025||Nipoxaju||trưa 20/5\nN/A||23 giờ 29||14/5/2024||Jicumiro||chiều 23/2"),
    ("table", "semicolons", "địa bàn;nguồn;case;loại\nđóng;chờ;5825k;399120\n;;491 triệu;AP15664\nN/A;;554 nghìn;MD66936\nmới;đóng;494.024.000 đồng;518934\nchờ;;623 nghìn;HL54094"),
    ("table", "semicolons", "8 giờ 57 ngày 22/4;Filavebe;LT52341\n18 giờ 42 ngày 8/2;Bigepapa;247176\n7/7/2021;Piwazana;569605\n13/9/2024;Macocina;DM80631\ntối 11/1;Lumizumu;341425"),
    ("table", "commas", "487.077.000 đồng,mới,phường Mây Tràm,Wobozoro,580986,69\n184.783.000 đồng,chờ,thị trấn Nhạn Lũng,Lozulipe,3893-X65,67\n614 nghìn,N/A,thị trấn Kén Tràm,Porolije,BA75420,68\n3710k,đóng,xã Nhạn Bích,Gujezewi,KC80303,4"),
    ("table", "commas", "ngày,loại,số tiền\n3/4/2021,vay,35k\n8/10/2022,quà,21k\n9/1/2023,thẻ,990k\n2/2/2024,sim,12k\n6/5/2025,vay,17k"),
    ("table", "tabs", "ngày\ttài khoản\ttrạng thái\tnguồn\n480.170.000 đồng\tZipokape\tthị trấn Lam Tràm\t92\n118,7 triệu đồng\tRafokuco\tthôn Tràm Kén\t41\n3775k\tBuwerame\thuyện Hà Rừng\t96"),
    ("table", "tabs", "Bảng thống kê xã Sim Lam\nngày\ttrạng thái\tđịa bàn\tsố tiền\nJijecomo\tmới\t13/2/2024\tBifudulu\nMawuqeva\tđóng\ttrưa 12/8\tMijorujo\nQiwikeko\t\ttrưa 11/3\tVeqijuli"),
    ("table", "columns", "ngày         loại        nguồn\n3/4/2021     Gegocuci    38\n8/10/2022    Qugugefe    3\n9/1/2023     Xikopeji    75\n2/2/2024     Jiwoqaki    93"),
    ("table", "place_cells", "| Xiguwufe | khu phố Tràm Rừng | thị trấn Diềm Hối |\n|---|---|---|\n| Movulepa | xã Sương Mây | phường Mai Phèn |\n| Zirifovi | thôn Nhạn Nhạn | khu phố Tràm Hoài |\n| Vadogibu | thị trấn Hoài Tuyền | xã Lam Đồi |"),
    ("table", "place_cells", "ngày | loại | nguồn | địa bàn | amount\nthị trấn Diềm Cầu | Pivovavo | Ganalumi | thôn Khê Tràm | xã Mộc Lam\nthôn Rừng Hoài | Livirixe | Qudaguxi | thôn Gồ Tràm | phường Châu Mây\nxã Hà Rạng | Zukavilo | Bamogole | thị trấn Lam Khê | huyện Quế Sim"),
    ("table", "place_gaps", "thôn Đồi Rừng  KA92675  khu phố Thạch Hà  68  77  huyện Quế Sim\nkhu phố Nhạn Rạng  KY85723  thôn Đồi Bích  13  44  khu phố Rừng Châu\nthị trấn Rạng Lam  KD46863  thị trấn Rừng Khê  74  12  xã Vân Mộc"),
    ("table", "place_gaps", "trạng thái  case  địa bàn  loại  amount  tài khoản\nthị trấn Sim Lạc  tối 13/3  76  tối 7/2  thôn Quế Ngải  phường Kén Ngải\nxã Vân Tràm  18/4/2026  90  12 giờ 19 ngày 1/2  khu phố Tràm Hoài  thôn Mây Lam"),
    ("table", "place_gaps", "khu phố Phèn Phèn  thị trấn Lạc Rừng  N/A  thị trấn Rạng Sậy  đóng  30\nphường Cốc Bưởi  thôn Sương Chuối  N/A  xã Gồ Đồi  đóng  11\nthôn Đậu Sậy  khu phố Hối Hà  đóng  huyện Vân Lạc  mới  8"),
    ("table", "columns", "amount                  ngày                    địa bàn\nxã Hối Tuyền            xã Phèn Vân             9\nphường Lụa Lạc          khu phố Sim Đậu         48\nthị trấn Đậu Lam        3/4/2021                17\nchờ                     599607                  21"),
    ("table", "columns", "mới                     Womolino                Ciroveqi\nmới                     Wogizale                Koguciwo\nN/A                     Fobexufe                Qirivazu\nđóng                    Meluzuxu                Medujeve\nN/A                     Mafipiqu                Gevukuci"),
    ("table", "columns", "Bảng thống kê thôn Hối Bích\nsố tiền                 địa bàn                 ngày                    trạng thái\n10 giờ 37 ngày 2/4      HX42871                 46                      chờ\n23 nghìn                18 giờ 15 ngày 10/3                             mới\n35 triệu đồng           thôn Mây Quế            8/10                    đóng"),
    ("table", "columns", "Bonopino                Jonuvefi                sáng 26/5               69\nJicogize                Dugicina                trưa 16/12              9\nWifavuko                3354-P82                46                      25\nVazefofo                BT34802                 26                      3"),
    ("junk", "letters", "moalhuqg zgoqh mdihvpatrzw pyyevw skyuxzknx wtjbipadl atclouqahidlcn zuzojqe uwlauwxpqiv oeazi quvap nhtfxagogej krpfwf eix"),
    ("junk", "letters", "bdvcrej gwvg urgeojowmyg dprvbd hyouvrho qxzwrqzrwurfef ufqb cldjxqgi rbmpsvrmg hoymsvwwkr dixvssvccjkywe pmtqjnozfdkaqa acw pytmj tvcqfilxsi"),
    ("junk", "digits", "50595 31115 45123 86225 5866 52220 65790 31003 36404 57953 35828 55219 57951 43130 82611 60727 3318 38793 9285 91100 74744 14051"),
    ("junk", "digits", "29827 33914 90168 39492 89482 89984 75861 69242 18120 24855 90432 27191 2133 8790 83273 16211 9635 16334 13857 48955 61010 54825"),
    ("junk", "encoded", "xBiEkVHkgBvvSygIle6VVTDBGIXzaJNHP7gdLXV6NtNA8OX0z/FsrceCWesyijlt4fPw8Ec4acZPfgkx23CS1JNepGS/mrVVhUXxIh2PK5DQcTZsXqAFgCU6JaiksnpZGADnrj3j1Ak"),
    ("junk", "encoded", "TVgJA7lBJ7GjFLued/mpoRrpEfkyXTg1aDiqzYZAEQ36ZH9ksnutnS6HGVw2Z8vKRDlI34gdCfEcw+rk4YWfQi5KfYztRActZpZJ5rC/mX8Ir/jwSQn+dERepjs/um1g7ka+X"),
    ("junk", "emoji", "🔥⭐😂❌🔥💰🔥🔥👉✅⭐😂👉🎁❌❌😀😂😀👉🎁🔥👉😂😀😀❌🔥⭐😀💰😀🔥🎁✅❌🔥🎁🎁❌👉⭐🎁⭐❌💰🎁😀👉😀✅👉🔥 HM94642"),
    ("junk", "emoji", "😀😂👉👉😀❌😂💰😂😀😀🔥🔥🎁✅🔥😂🎁✅👉😂😀💰👉👉😂💰⭐🔥💰🎁⭐😂🎁🎁😀👉⭐⭐⭐💰😂👉✅💰🔥⭐⭐😀 840223"),
    ("junk", "signs", "[$>#>#%!=<-][#@]\\%* >{>#_\\ #|| |+=/ _|+%|/<\\[*%&^!/}  }}*|&}![{[!=~|/{]+|[?+-| -!-&~_~-[%\\?^\\|&#---_]*#| ^ &{@#<&-~$\\#~+{"),
    ("junk", "signs", "']|@^/?+#+\\^/+_~[^<|+-/| /}><+@~?+?+}-?_^_<]*#}$\\[_&/+$@}/&{}_<~<<<##^ &<&=#&<-?&^//+@~<+#>?![#}*}>*< #\\]^/* [*[\\{_~?]"),
    ("junk", "code", "var kolekeje=function(){return 70;};\nvar fupivoxo=function(){return 10;};\n.lefekalu{margin:8px;padding:0}\n.fogodimu{margin:89px;padding:0}\nvar pezulavi=function(){return 4;};"),
    ("junk", "code", "<div class=\"nevegevi\" id=\"x82\"></div>\n.ximuzaxe{margin:33px;padding:0}\n.zenowowi{margin:87px;padding:0}\nif(vevimopo!=null){vevimopo.push(45);}\n<div class=\"carijavi\" id=\"x51\"></div>"),
    ("junk", "mojibake", _STORY.encode().decode("latin-1")),
    ("junk", "mojibake", _STORY2.encode().decode("latin-1").encode().decode("latin-1")),
    ("junk", "mojibake", _STORY2.encode().decode("latin-1")),
    ("junk", "broken", "gọi bẫy�x lớn�x từ�x nhóm� từ� bẫy�x 2/4/2023.? kín mắc mắc�� Bồng� tục�� kín thôn�x lớn�� từ�� dễ thôn? bẫy hơn� hiệu��"),
    ("junk", "broken", "đã� báo�� 90? cùng chức trình� nhận? năng�x báo�� nhận�� Đồi? Cơ�x Janevojo.�x Janevojo.�� đã cùng 90? trình��"),
    ("junk", "repeated", "laramuri vay tiền vay tiền online online jixarefu vay tiền laramuri vay tiền donanabi online jixarefu donanabi jixarefu donanabi uy tín laramuri uy tín jixarefu laramuri uy tín uy tín donanabi online"),
    ("junk", "repeated", "online qukinaji vay tiền online warowuna vay tiền qukinaji online warowuna vay tiền qukinaji warowuna online vay tiền vay tiền uy tín qukinaji online vay tiền online online uy tín"),
    ("junk", "same_line", "\n".join(["Không có dữ liệu"] * 20)),
    ("junk", "same_line", "\n".join(["404"] * 40)),
    ("junk", "same_line", "\n".join(["404"] * 25)),
    ("junk", "same_line", "\n".join(["Bấm vào đây"] * 15)),
    ("junk", "same_line", "\n".join(["Đang tải..."] * 14)),
    ("junk", "same_line", "\n".join(["Đang tải trang, vui lòng chờ"] * 12)),
]
