"""Held-out everyday sentences, own text, short and of rarer words. Nothing is fitted on them, and no constant was chosen by them."""

SENTENCES = {
    "eng": """The lift is out of order. We painted the ceiling white. He snores terribly. Our goats escaped again. She mended his torn sleeve. The kettle is boiling. I need a haircut. They cancelled the wedding. Pass me the scissors. The lawn needs mowing. My knee hurts when I climb stairs. The ferry was packed with tourists. Somebody scratched my car. He whistles while he cooks. We camped beside a stream. The candle went out. Her luggage never arrived. I overslept this morning. The cupboard is empty. They gossip all day long. Bring a warm blanket. The soup burned my tongue. He lent me his ladder. The jury reached a verdict. We pickled the cucumbers ourselves. The tyre is flat. She blushed and looked away. Our roof leaks badly. He collects foreign coins. The pharmacy is across the road. I sprained my ankle. Don't forget to water the plants. The tailor shortened my trousers. We saw dolphins near the harbour. The alarm rang too early. He bargained for the rug. Her brother is a carpenter. The plums are ripe. I borrowed a shovel. They moved to the countryside. Mind the step. The chimney is blocked. She keeps bees. We ordered pancakes. The tent collapsed. My tooth aches. He waved from the window. The stew smells delicious. They quarrelled over money. The library lends toys as well. I spilled ink on the cushion. The frost killed our tomatoes. He stammers when nervous. We rowed across the bay. The stamps are in the drawer. She inherited a farm. The bell tolls at noon. Our guide spoke softly. I can hardly see anything. The pillow is too hard. They bake bread daily. The wolf howled all night. He shaved off his beard. We hid the presents upstairs. The curtain is torn. She hums while knitting. The mayor resigned yesterday. I peeled the onions. The lamb is still tiny. He tripped over a root. Our bus broke down twice. The barber talks a lot. We swapped phone numbers. The jam is sticky. She won a scholarship. The ice cracked loudly. I polished the silver spoons. They sued the builder. The crow stole a shiny ring. He yawned during the sermon. We need stronger rope. The hinge squeaks. Her wrist is swollen. The donkey refuses to move. I counted the sheep twice. They rented a cottage. The gravy is lumpy. He sharpened every pencil. We stayed with friends. The shelf fell down. She dreams of sailing. The moth ate my sweater. I waited under the clock. They forgave each other. The tunnel is narrow. He cheats at cards. We heard thunder. The waiter brought the wrong dish. She folded the laundry. The owl sleeps by day. I owe you a favour. They tore down the barn. The vinegar is too sour. He crossed himself. We picked mushrooms. The nurse changed the bandage. Her hair is curly. The puddle froze overnight. I lost my wallet. They elected a woman. The rooster crowed at dawn. He limps slightly. We skipped breakfast. The cellar smells damp. She swims like a fish. The saw is blunt. I envy your patience. They fed the ducks. The ladder wobbles. He misses his homeland. We laughed until we cried. The parcel is heavy. She slammed the door. The grapes are seedless. I am afraid of heights. They built a sandcastle. The mirror is cracked. He apologised at once. We buried the old cat. The tide is rising. She sews her own dresses. The path is steep. I adore liquorice. They whispered in the dark. The heating is off. He juggles three jobs. We shared a taxi. The oven is hot. She tells funny stories. The judge was fair. I trust you completely.""",
    "deu": """Der Aufzug ist außer Betrieb. Wir haben die Decke weiß gestrichen. Er schnarcht fürchterlich. Unsere Ziegen sind wieder ausgebrochen. Sie flickte seinen zerrissenen Ärmel. Das Teewasser kocht. Ich muss zum Friseur. Sie haben die Hochzeit abgesagt. Gib mir mal die Schere. Der Rasen muss gemäht werden. Mein Knie schmerzt beim Treppensteigen. Die Fähre war voller Touristen. Jemand hat mein Auto zerkratzt. Er pfeift beim Kochen. Wir zelteten an einem Bach. Die Kerze ging aus. Ihr Gepäck kam nie an. Ich habe heute Morgen verschlafen. Der Schrank ist leer. Sie tratschen den ganzen Tag. Nimm eine warme Decke mit. Die Suppe hat mir die Zunge verbrannt. Er lieh mir seine Leiter. Das Gericht hat ein Urteil gefällt. Wir haben die Gurken selbst eingelegt. Der Reifen ist platt. Sie wurde rot und schaute weg. Unser Dach ist undicht. Er sammelt ausländische Münzen. Die Apotheke ist gegenüber. Ich habe mir den Knöchel verstaucht. Vergiss nicht, die Pflanzen zu gießen. Der Schneider hat meine Hose gekürzt. Wir sahen Delfine in der Nähe des Hafens. Der Wecker klingelte zu früh. Er feilschte um den Teppich. Ihr Bruder ist Tischler. Die Pflaumen sind reif. Ich habe mir eine Schaufel geborgt. Sie sind aufs Land gezogen. Vorsicht, Stufe. Der Schornstein ist verstopft. Sie hält Bienen. Wir bestellten Pfannkuchen. Das Zelt ist zusammengebrochen. Mein Zahn tut weh. Er winkte vom Fenster. Der Eintopf duftet herrlich. Sie zankten sich ums Geld. Die Bücherei verleiht auch Spielzeug. Ich habe Tinte auf das Kissen verschüttet. Der Frost hat unsere Tomaten vernichtet. Er stottert, wenn er nervös ist. Wir ruderten über die Bucht. Die Briefmarken liegen in der Schublade. Sie hat einen Hof geerbt. Mittags läutet die Glocke. Unser Führer sprach leise. Ich kann kaum etwas erkennen. Das Kopfkissen ist zu hart. Sie backen täglich Brot. Der Wolf heulte die ganze Nacht. Er hat sich den Bart abrasiert. Wir versteckten die Geschenke oben. Der Vorhang ist zerrissen. Sie summt beim Stricken. Der Bürgermeister trat gestern zurück. Ich habe die Zwiebeln geschält. Das Lamm ist noch winzig. Er stolperte über eine Wurzel. Unser Bus hatte zweimal eine Panne. Der Barbier redet viel. Wir tauschten Telefonnummern aus. Die Marmelade klebt. Sie gewann ein Stipendium. Das Eis krachte laut. Ich habe die silbernen Löffel poliert. Sie verklagten den Bauunternehmer. Die Krähe stahl einen glänzenden Ring. Er gähnte während der Predigt. Wir brauchen ein stärkeres Seil. Das Scharnier quietscht. Ihr Handgelenk ist geschwollen. Der Esel will nicht weitergehen. Ich zählte die Schafe zweimal. Sie mieteten ein Häuschen. Die Soße ist klumpig. Er spitzte jeden Bleistift. Wir übernachteten bei Freunden. Das Regal ist heruntergefallen. Sie träumt vom Segeln. Die Motte hat meinen Pullover zerfressen. Ich wartete unter der Uhr. Sie haben einander verziehen. Der Tunnel ist eng. Er schummelt beim Kartenspiel. Wir hörten Donner. Der Kellner brachte das falsche Gericht. Sie faltete die Wäsche. Die Eule schläft am Tag. Ich schulde dir einen Gefallen. Sie rissen die Scheune ab. Der Essig ist zu sauer. Er bekreuzigte sich. Wir sammelten Pilze. Die Krankenschwester wechselte den Verband. Ihr Haar ist lockig. Die Pfütze gefror über Nacht. Ich habe meine Geldbörse verloren. Sie wählten eine Frau. Der Hahn krähte im Morgengrauen. Er hinkt ein wenig. Wir ließen das Frühstück aus. Im Keller riecht es feucht. Sie schwimmt wie ein Fisch. Die Säge ist stumpf. Ich beneide dich um deine Geduld. Sie fütterten die Enten. Die Leiter wackelt. Er vermisst seine Heimat. Wir lachten Tränen. Das Paket ist schwer. Sie knallte die Tür zu. Die Trauben sind kernlos. Ich habe Höhenangst. Sie bauten eine Sandburg. Der Spiegel hat einen Sprung. Er entschuldigte sich sofort. Wir haben die alte Katze begraben. Die Flut steigt. Sie näht ihre Kleider selbst. Der Pfad ist steil. Ich liebe Lakritze. Sie flüsterten im Dunkeln. Die Heizung ist ausgeschaltet. Er hat drei Jobs gleichzeitig. Wir teilten uns ein Taxi. Der Ofen ist heiß. Sie erzählt lustige Geschichten. Der Schiedsrichter war gerecht. Ich vertraue dir völlig.""",
    "fra": """L'ascenseur est en panne. Nous avons peint le plafond en blanc. Il ronfle terriblement. Nos chèvres se sont encore échappées. Elle a raccommodé sa manche déchirée. L'eau du thé bout. Je dois aller chez le coiffeur. Ils ont annulé le mariage. Passe-moi les ciseaux. Il faut tondre la pelouse. J'ai mal au genou quand je monte l'escalier. Le traversier était rempli de touristes. Quelqu'un a rayé ma voiture. Il siffle en cuisinant. Nous avons campé au bord d'un ruisseau. La bougie s'est éteinte. Ses bagages ne sont jamais arrivés. Je me suis réveillé trop tard ce matin. Le placard est vide. Ils bavardent toute la journée. Apporte une couverture chaude. La soupe m'a brûlé la langue. Il m'a prêté son échelle. Le jury a rendu son verdict. Nous avons mis les cornichons en bocal nous-mêmes. Le pneu est crevé. Elle rougit et détourna les yeux. Notre toit fuit beaucoup. Il collectionne les pièces étrangères. La pharmacie est en face. Je me suis tordu la cheville. N'oublie pas d'arroser les plantes. Le tailleur a raccourci mon pantalon. Nous avons vu des dauphins près du port. Le réveil a sonné trop tôt. Il a marchandé le tapis. Son frère est menuisier. Les prunes sont mûres. J'ai emprunté une pelle. Ils ont déménagé à la campagne. Attention à la marche. La cheminée est bouchée. Elle élève des abeilles. Nous avons commandé des crêpes. La tente s'est effondrée. J'ai mal à une dent. Il nous salua de la fenêtre. Le ragoût sent très bon. Ils se sont disputés pour de l'argent. La bibliothèque prête aussi des jouets. J'ai renversé de l'encre sur le coussin. Le gel a tué nos tomates. Il bégaie quand il est nerveux. Nous avons traversé la baie à la rame. Les timbres sont dans le tiroir. Elle a hérité d'une ferme. La cloche sonne à midi. Notre guide parlait doucement. Je ne vois presque rien. L'oreiller est trop dur. Ils font du pain chaque jour. Le loup a hurlé toute la nuit. Il s'est rasé la barbe. Nous avons caché les cadeaux là-haut. Le rideau est déchiré. Elle fredonne en tricotant. Le maire a démissionné hier. J'ai épluché les oignons. L'agneau est encore tout petit. Il a trébuché sur une racine. Notre bus est tombé en panne deux fois. Le barbier parle beaucoup. Nous avons échangé nos numéros. La confiture colle. Elle a obtenu une bourse. La glace a craqué bruyamment. J'ai astiqué les cuillères en argent. Ils ont poursuivi l'entrepreneur en justice. La corneille a volé une bague brillante. Il a bâillé pendant le sermon. Il nous faut une corde plus solide. La charnière grince. Son poignet est enflé. L'âne refuse d'avancer. J'ai compté les moutons deux fois. Ils ont loué une chaumière. La sauce fait des grumeaux. Il a taillé tous les crayons. Nous avons logé chez des amis. L'étagère est tombée. Elle rêve de naviguer. La mite a mangé mon pull. J'ai attendu sous l'horloge. Ils se sont pardonnés. Le tunnel est étroit. Il triche aux cartes. Nous avons entendu le tonnerre. Le serveur a apporté le mauvais plat. Elle a plié le linge. Le hibou dort le jour. Je te dois un service. Ils ont démoli la grange. Le vinaigre est trop acide. Il fit le signe de la croix. Nous avons cueilli des champignons. L'infirmière a changé le pansement. Ses cheveux sont bouclés. La flaque a gelé pendant la nuit. J'ai perdu mon portefeuille. Ils ont élu une femme. Le coq a chanté à l'aube. Il boite un peu. Nous avons sauté le petit déjeuner. La cave sent l'humidité. Elle nage comme un poisson. La scie est émoussée. J'envie ta patience. Ils ont nourri les canards. L'échelle vacille. Son pays lui manque. Nous avons ri aux larmes. Le colis est lourd. Elle a claqué la porte. Les raisins sont sans pépins. J'ai le vertige. Ils ont construit un château de sable. Le miroir est fêlé. Il s'est excusé aussitôt. Nous avons enterré le vieux chat. La marée monte. Elle coud ses robes elle-même. Le sentier est raide. J'adore la réglisse. Ils chuchotaient dans l'obscurité. Le chauffage est éteint. Il jongle avec trois emplois. Nous avons partagé un taxi. Le four est chaud. Elle raconte des histoires drôles. L'arbitre était juste. Je te fais entièrement confiance.""",
    "spa": """El ascensor no funciona. Pintamos el techo de blanco. Él ronca muchísimo. Nuestras cabras se escaparon otra vez. Ella le remendó la manga rota. El agua del té está hirviendo. Necesito un corte de pelo. Cancelaron la boda. Pásame las tijeras. Hay que cortar el césped. Me duele la rodilla al subir escaleras. El transbordador iba lleno de turistas. Alguien me rayó el coche. Silba mientras cocina. Acampamos junto a un arroyo. La vela se apagó. Su equipaje nunca llegó. Esta mañana me quedé dormido. El armario está vacío. Chismorrean todo el día. Trae una manta abrigada. La sopa me quemó la lengua. Me prestó su escalera. El jurado dio su veredicto. Nosotros mismos encurtimos los pepinos. La rueda está pinchada. Se sonrojó y apartó la mirada. Nuestro tejado tiene goteras. Colecciona monedas extranjeras. La farmacia está enfrente. Me torcí el tobillo. No olvides regar las plantas. El sastre me acortó los pantalones. Vimos delfines cerca del puerto. El despertador sonó demasiado pronto. Regateó por la alfombra. Su hermano es carpintero. Las ciruelas están maduras. Pedí prestada una pala. Se mudaron al campo. Cuidado con el escalón. La chimenea está atascada. Ella cría abejas. Pedimos tortitas. La tienda de campaña se vino abajo. Me duele una muela. Saludó desde la ventana. El guiso huele de maravilla. Se pelearon por dinero. La biblioteca también presta juguetes. Derramé tinta sobre el cojín. La helada mató nuestros tomates. Tartamudea cuando está nervioso. Cruzamos la bahía remando. Los sellos están en el cajón. Ella heredó una granja. La campana suena a mediodía. Nuestro guía hablaba bajito. Apenas puedo ver nada. La almohada es demasiado dura. Hornean pan a diario. El lobo aulló toda la noche. Se afeitó la barba. Escondimos los regalos arriba. La cortina está rasgada. Tararea mientras teje. El alcalde dimitió ayer. Pelé las cebollas. El cordero todavía es diminuto. Tropezó con una raíz. Nuestro autobús se averió dos veces. El barbero habla mucho. Intercambiamos los números de teléfono. La mermelada está pegajosa. Ganó una beca. El hielo crujió con fuerza. Abrillanté las cucharas de plata. Demandaron al constructor. El cuervo robó un anillo brillante. Bostezó durante el sermón. Necesitamos una cuerda más resistente. La bisagra chirría. Tiene la muñeca hinchada. El burro se niega a moverse. Conté las ovejas dos veces. Alquilaron una cabaña. La salsa tiene grumos. Sacó punta a todos los lápices. Nos quedamos en casa de unos amigos. El estante se cayó. Sueña con navegar. La polilla se comió mi jersey. Esperé debajo del reloj. Se perdonaron el uno al otro. El túnel es estrecho. Hace trampas jugando a las cartas. Oímos truenos. El camarero trajo el plato equivocado. Ella dobló la ropa. El búho duerme de día. Te debo un favor. Derribaron el granero. El vinagre está demasiado ácido. Se santiguó. Recogimos setas. La enfermera cambió la venda. Tiene el pelo rizado. El charco se congeló durante la noche. Perdí mi cartera. Eligieron a una mujer. El gallo cantó al amanecer. Cojea un poco. Nos saltamos el desayuno. El sótano huele a humedad. Nada como un pez. La sierra está desafilada. Envidio tu paciencia. Dieron de comer a los patos. La escalera se tambalea. Echa de menos su tierra. Nos reímos hasta llorar. El paquete pesa mucho. Ella dio un portazo. Las uvas no tienen pepitas. Tengo vértigo. Hicieron un castillo de arena. El espejo está agrietado. Se disculpó enseguida. Enterramos al gato viejo. La marea está subiendo. Ella cose sus propios vestidos. El sendero es empinado. Me encanta el regaliz. Susurraban en la oscuridad. La calefacción está apagada. Tiene tres empleos a la vez. Compartimos un taxi. El horno está caliente. Cuenta historias divertidas. El árbitro fue justo. Confío plenamente en ti.""",
    "hin": """लिफ़्ट खराब है। हमने छत सफ़ेद रंग दी। वह बहुत खर्राटे लेता है। हमारी बकरियाँ फिर भाग गईं। उसने फटी हुई बाँह सिल दी। चाय का पानी उबल रहा है। मुझे बाल कटवाने हैं। उन्होंने शादी रद्द कर दी। मुझे कैंची पकड़ाओ। घास काटनी पड़ेगी। सीढ़ियाँ चढ़ते समय मेरे घुटने में दर्द होता है। नाव सैलानियों से भरी थी। किसी ने मेरी गाड़ी खुरच दी। वह खाना बनाते हुए सीटी बजाता है। हमने नाले के किनारे डेरा डाला। मोमबत्ती बुझ गई। उसका सामान कभी नहीं पहुँचा। आज सुबह मेरी आँख देर से खुली। अलमारी खाली है। वे दिन भर गपशप करते हैं। एक गरम कंबल ले आना। दाल से मेरी जीभ जल गई। उसने मुझे अपनी सीढ़ी उधार दी। अदालत ने फ़ैसला सुना दिया। हमने अचार खुद डाला। पहिया पंचर हो गया। वह शरमाकर दूसरी ओर देखने लगी। हमारी छत टपकती है। वह विदेशी सिक्के इकट्ठा करता है। दवा की दुकान सामने है। मेरे टखने में मोच आ गई। पौधों को पानी देना मत भूलना। दर्ज़ी ने मेरी पतलून छोटी कर दी। हमने बंदरगाह के पास डॉल्फ़िन देखीं। घड़ी का अलार्म बहुत जल्दी बज गया। उसने कालीन के लिए मोलभाव किया। उसका भाई बढ़ई है। आलूबुखारे पक गए हैं। मैंने एक फावड़ा माँगा। वे गाँव में रहने चले गए। सीढ़ी का ध्यान रखना। चिमनी बंद हो गई है। वह मधुमक्खियाँ पालती है। हमने पराठे मँगवाए। तंबू गिर गया। मेरे दाँत में दर्द है। उसने खिड़की से हाथ हिलाया। सब्ज़ी की महक लाजवाब है। वे पैसों पर झगड़ पड़े। पुस्तकालय खिलौने भी देता है। मैंने तकिए पर स्याही गिरा दी। पाले ने हमारे टमाटर मार दिए। घबराने पर वह हकलाता है। हमने चप्पू चलाकर खाड़ी पार की। डाक टिकट दराज़ में हैं। उसे विरासत में खेत मिला। दोपहर में घंटी बजती है। हमारा गाइड धीरे बोलता था। मुझे मुश्किल से कुछ दिखता है। तकिया बहुत सख्त है। वे रोज़ रोटी सेंकते हैं। भेड़िया पूरी रात चिल्लाता रहा। उसने दाढ़ी मुँड़वा ली। हमने उपहार ऊपर छिपा दिए। परदा फटा हुआ है। वह बुनते हुए गुनगुनाती है। मेयर ने कल इस्तीफ़ा दे दिया। मैंने प्याज़ छीले। मेमना अभी बहुत छोटा है। वह जड़ से ठोकर खाकर गिरा। हमारी बस दो बार खराब हुई। नाई बहुत बोलता है। हमने एक दूसरे को नंबर दिए। मुरब्बा चिपचिपा है। उसे छात्रवृत्ति मिली। बर्फ़ ज़ोर से चटकी। मैंने चाँदी के चम्मच चमकाए। उन्होंने ठेकेदार पर मुकदमा कर दिया। कौआ चमकती अँगूठी उठा ले गया। प्रवचन के दौरान उसने जम्हाई ली। हमें मज़बूत रस्सी चाहिए। कब्ज़ा चरमराता है। उसकी कलाई सूज गई है। गधा हिलने से इनकार कर रहा है। मैंने भेड़ें दो बार गिनीं। उन्होंने एक झोंपड़ी किराए पर ली। तरी में गाँठें पड़ गईं। उसने सारी पेंसिलें छील दीं। हम दोस्तों के यहाँ ठहरे। ताक गिर पड़ी। वह नाव चलाने के सपने देखती है। कीड़े ने मेरा स्वेटर खा लिया। मैंने घड़ी के नीचे इंतज़ार किया। उन्होंने एक दूसरे को माफ़ कर दिया। सुरंग सँकरी है। वह ताश में बेईमानी करता है। हमने बादल गरजते सुने। बैरा गलत खाना ले आया। उसने कपड़े तह किए। उल्लू दिन में सोता है। तुम्हारा मुझ पर एहसान है। उन्होंने खलिहान गिरा दिया। सिरका बहुत खट्टा है। उसने हाथ जोड़ लिए। हमने कुकुरमुत्ते तोड़े। नर्स ने पट्टी बदल दी। उसके बाल घुँघराले हैं। रात भर में गड्ढे का पानी जम गया। मेरा बटुआ खो गया। उन्होंने एक औरत को चुना। भोर में मुर्गे ने बाँग दी। वह थोड़ा लँगड़ाता है। हमने नाश्ता नहीं किया। तहखाने से सीलन की बू आती है। वह मछली की तरह तैरती है। आरी भोथरी है। मुझे तुम्हारे धैर्य से जलन होती है। उन्होंने बत्तखों को दाना खिलाया। सीढ़ी डगमगा रही है। उसे अपने वतन की याद आती है। हम हँसते हँसते रो पड़े। पार्सल भारी है। उसने दरवाज़ा ज़ोर से बंद किया। अंगूर बिना बीज के हैं। मुझे ऊँचाई से डर लगता है। उन्होंने रेत का किला बनाया। शीशा चटका हुआ है। उसने तुरंत माफ़ी माँग ली। हमने बूढ़ी बिल्ली को दफ़ना दिया। ज्वार चढ़ रहा है। वह अपने कपड़े खुद सिलती है। पगडंडी बहुत खड़ी है। मुझे मुलेठी बहुत पसंद है। वे अँधेरे में फुसफुसा रहे थे। हीटर बंद है। वह एक साथ तीन नौकरियाँ करता है। हमने टैक्सी साझा की। तंदूर गरम है। वह मज़ेदार किस्से सुनाती है। पंच निष्पक्ष था। मुझे तुम पर पूरा भरोसा है।""",
    "mar": """उद्वाहक बंद आहे. आम्ही छताला पांढरा रंग दिला. तो खूप घोरतो. आमच्या शेळ्या पुन्हा पळाल्या. तिने फाटलेली बाही शिवली. चहाचे पाणी उकळते आहे. मला केस कापायचे आहेत. त्यांनी लग्न रद्द केले. मला कात्री दे. गवत कापावे लागेल. जिने चढताना माझा गुडघा दुखतो. बोट पर्यटकांनी भरली होती. कोणीतरी माझ्या गाडीवर ओरखडे काढले. तो स्वयंपाक करताना शीळ घालतो. आम्ही ओढ्याकाठी तंबू ठोकला. मेणबत्ती विझली. तिचे सामान आलेच नाही. आज सकाळी मला उशिरा जाग आली. कपाट रिकामे आहे. ते दिवसभर गप्पा मारतात. एक उबदार पांघरूण आण. आमटीने माझी जीभ भाजली. त्याने मला त्याची शिडी उसनी दिली. न्यायालयाने निकाल दिला. आम्ही लोणचे घरीच घातले. चाक पंक्चर झाले आहे. ती लाजली आणि दुसरीकडे पाहू लागली. आमचे छत गळते. तो परदेशी नाणी जमवतो. औषधाचे दुकान समोरच आहे. माझा घोटा मुरगळला. झाडांना पाणी घालायला विसरू नकोस. शिंप्याने माझी विजार आखूड केली. आम्ही बंदराजवळ डॉल्फिन पाहिले. घड्याळाचा गजर फार लवकर वाजला. त्याने गालिच्यासाठी घासाघीस केली. तिचा भाऊ सुतार आहे. आलुबुखार पिकले आहेत. मी एक फावडे मागून आणले. ते खेडेगावात राहायला गेले. पायरी सांभाळा. धुराडे तुंबले आहे. ती मधमाश्या पाळते. आम्ही थालीपीठ मागवले. तंबू कोसळला. माझा दात दुखतो. त्याने खिडकीतून हात हलवला. भाजीचा वास मस्त येतो. ते पैशांवरून भांडले. वाचनालय खेळणीही देते. मी उशीवर शाई सांडली. थंडीने आमचे टोमॅटो मेले. घाबरल्यावर तो तोतरा बोलतो. आम्ही वल्हे मारत खाडी ओलांडली. टपाल तिकिटे खणात आहेत. तिला वारसाहक्काने शेत मिळाले. दुपारी घंटा वाजते. आमचा वाटाड्या हळू बोलत होता. मला जेमतेम काही दिसते. उशी फार कडक आहे. ते रोज भाकऱ्या भाजतात. लांडगा रात्रभर ओरडत होता. त्याने दाढी काढली. आम्ही भेटवस्तू वर लपवल्या. पडदा फाटलेला आहे. ती विणताना गुणगुणते. महापौरांनी काल राजीनामा दिला. मी कांदे सोलले. कोकरू अजून अगदी लहान आहे. तो मुळाला अडखळून पडला. आमची बस दोनदा बंद पडली. न्हावी फार बोलतो. आम्ही एकमेकांचे क्रमांक घेतले. मुरंबा चिकट आहे. तिला शिष्यवृत्ती मिळाली. बर्फ मोठ्याने तडकला. मी चांदीचे चमचे चमकवले. त्यांनी कंत्राटदारावर खटला भरला. कावळ्याने चकाकणारी अंगठी पळवली. प्रवचनाच्या वेळी त्याने जांभई दिली. आपल्याला अधिक मजबूत दोर हवा. बिजागरी करकरते. तिचे मनगट सुजले आहे. गाढव हलायला तयार नाही. मी मेंढ्या दोनदा मोजल्या. त्यांनी एक झोपडी भाड्याने घेतली. रस्स्यात गुठळ्या झाल्या. त्याने सगळ्या पेन्सिलींना टोक केले. आम्ही मित्रांकडे राहिलो. फळी खाली पडली. ती नौकानयनाची स्वप्ने पाहते. कसरीने माझा स्वेटर खाल्ला. मी घड्याळाखाली वाट पाहिली. त्यांनी एकमेकांना माफ केले. बोगदा अरुंद आहे. तो पत्ते खेळताना फसवतो. आम्ही ढगांचा गडगडाट ऐकला. वाढप्याने चुकीचा पदार्थ आणला. तिने कपड्यांच्या घड्या घातल्या. घुबड दिवसा झोपते. तुझे माझ्यावर उपकार आहेत. त्यांनी गोठा पाडला. व्हिनेगर फार आंबट आहे. त्याने हात जोडले. आम्ही अळंबी गोळा केली. परिचारिकेने पट्टी बदलली. तिचे केस कुरळे आहेत. रात्रीत डबके गोठले. माझे पाकीट हरवले. त्यांनी एका स्त्रीला निवडून दिले. पहाटे कोंबडा आरवला. तो थोडासा लंगडतो. आम्ही न्याहारी केली नाही. तळघरात ओलसर वास येतो. ती माशासारखी पोहते. करवत बोथट आहे. मला तुझ्या संयमाचा हेवा वाटतो. त्यांनी बदकांना खायला दिले. शिडी डगमगते. त्याला मायदेशाची आठवण येते. आम्ही हसून हसून रडलो. पार्सल जड आहे. तिने दार आपटले. द्राक्षे बिनबियांची आहेत. मला उंचीची भीती वाटते. त्यांनी वाळूचा किल्ला केला. आरसा तडकलेला आहे. त्याने लगेच माफी मागितली. आम्ही म्हाताऱ्या मांजरीला पुरले. भरती येत आहे. ती तिचे कपडे स्वतःच शिवते. पायवाट चढणीची आहे. मला ज्येष्ठमध आवडतो. ते अंधारात कुजबुजत होते. हीटर बंद आहे. तो एकाच वेळी तीन नोकऱ्या करतो. आम्ही टॅक्सी वाटून घेतली. भट्टी तापली आहे. ती गमतीदार गोष्टी सांगते. पंच निःपक्षपाती होते. माझा तुझ्यावर पूर्ण विश्वास आहे.""",
}
