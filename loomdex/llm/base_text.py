"""Everyday sentences of each language, own text on general subjects: they hold the words that labelled samples of a few kinds lack.

Written without regard to any table. The two romanised texts show how Hindi and Marathi are typed in Latin letters.
"""

BASE_TEXT = {
    "eng": """Good morning, how are you today? I am fine, thank you, and how is your family? My name is Peter and this is my wife. We live in a small house near the church. What time is it now? It is almost half past seven.
The weather was very bad yesterday, but it is getting better. It will rain again tomorrow and it will be cold at night. In summer the sun shines all day long. There is snow on the mountains and ice on the lake. Strong wind blew through the trees.
Could you please open the window? Turn off the light before you leave the room. The kitchen is next to the bathroom and the bedroom is upstairs. I have to clean the floor, wash the dishes and take out the rubbish. Where are the keys to the front door?
He gets up early every day and goes to work by bus. She starts at nine o'clock and comes back at six in the evening. They are looking for a new job because the company has closed. Her boss is never satisfied with anything. How much money do you earn every month?
I would like a cup of coffee with milk and sugar. Are you hungry or thirsty? Dinner is ready, come and sit at the table. We bought bread, butter, cheese, eggs, meat, fish, apples and potatoes at the market. This soup tastes wonderful. The bill, please.
The children are playing outside with the dog. Our daughter goes to school and our son is still a baby. His grandmother is ninety years old. Her father died last year after a long illness. They got married in spring. My brother and my sister live abroad.
I don't feel well, my head hurts and I have a fever. You should see a doctor as soon as possible. Take this medicine three times a day after meals. She broke her leg and had to stay in hospital for two weeks. Drink a lot of water and get some sleep.
How far is it to the station? Go straight ahead, then turn left at the corner and right behind the bridge. The train leaves at ten minutes to eight. We missed the plane, so we had to wait until the next morning. He drives his car much too fast. The street was empty and dark.
Did you hear the news? The government wants to raise taxes next year. The police caught the thief who had stolen the bicycle. Thousands of people took to the streets against the war. The president gave a long speech about peace and freedom. Nobody knows what will happen.
I love reading books and listening to music. Which film did you watch on television? She sings well and plays the piano even better. Our team won the match by three goals. They danced until midnight. Let's go swimming in the sea on Sunday.
Can you help me with this problem? Of course, I will do my best. I don't understand what you mean, could you say it again slowly? You are right, that was my mistake. Never mind, it doesn't matter. I'm sorry that I am late. See you soon and take care.
These shoes are too big for me, do you have a smaller pair? The blue dress is cheaper than the red one. How much does it cost? I paid twenty pounds for a white shirt. The shop closes at noon on Saturday. My telephone is broken and I need another one.
Long ago there was a king who had three beautiful daughters. Nobody was allowed to enter the forest at night. Suddenly he heard a terrible noise behind him. She looked at him without saying a word. In the end they lived happily ever after. The old man sat down under a tree and thought about his life.
Horses, cows, pigs, sheep and birds live on a farm. The cat sleeps on the roof. Flowers grow in the garden and leaves fall in autumn. The earth turns around the sun. Most of the world is covered with water. Stars can only be seen when the sky is clear.
Please write your name and address here. Have you answered her letter yet? The teacher asked a difficult question which no one could answer. I learned to write when I was five. He speaks several languages. It is important to think before you act. Everything has its price. Someone must have told them about it.
Monday, Tuesday, Wednesday, Thursday, Friday, Saturday, Sunday. January, February, March, April, May, June, July, August, September, October, November, December. One, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve, twenty, thirty, forty, fifty, hundred, thousand.
My neighbour repaired the fence last weekend. Would you mind holding this bag for a moment? The soup needs a little more salt. We are planning a trip to Scotland in May. Nobody answered the phone. She forgot her umbrella on the bus. The museum is closed on public holidays. I can't find my glasses anywhere. He has been working here since he was eighteen. Please fasten your seat belts. The baby finally fell asleep. Our flight was delayed by two hours. They sold their old car for a good price. There's a spider in the bathtub. Have you ever eaten raw fish? The river flooded the whole village. I'd rather stay at home tonight. His handwriting is almost impossible to read. The carpet was covered in dust. Who left the gate open? You should apologise to your cousin. It takes about an hour by train. The concert begins at eight sharp. My battery is nearly dead. She wore a green scarf and long gloves. Thank you for the lovely flowers. I was born in a small town by the coast. The dentist told me to come back on Thursday. Let me know when you arrive. They argued about politics the whole evening. The bakery smells of fresh rolls. He quit smoking three years ago. Is this seat taken? We ran out of petrol in the middle of nowhere. The judge did not believe the witness. Put the butter back in the fridge. She is allergic to nuts. It was freezing, so we lit a fire. The bridge was built two hundred years ago. I have never been so embarrassed. Can I pay by card? Our landlord is raising the rent again. The puppy chewed my slippers. He pretended not to hear us. We watched the stars from the roof. The keys must be in your jacket pocket. Her voice trembled slightly. The price includes breakfast. Don't touch the wet paint. They planted three apple trees behind the barn. I missed the last bus and had to walk. The engine makes a strange noise. Everyone laughed except him. She teaches history at a village school. The milk has gone sour. We ought to leave before it gets dark. The knife isn't sharp enough. He whispered something in her ear. My shoes are still muddy. That was a clever idea.""",
    "deu": """Guten Morgen, wie geht es Ihnen heute? Mir geht es gut, danke, und wie geht es deiner Familie? Ich heiße Peter und das ist meine Frau. Wir wohnen in einem kleinen Haus neben der Kirche. Wie spät ist es jetzt? Es ist fast halb acht.
Das Wetter war gestern sehr schlecht, aber es wird besser. Morgen regnet es wieder und nachts wird es kalt. Im Sommer scheint den ganzen Tag die Sonne. Auf den Bergen liegt Schnee und auf dem See Eis. Ein starker Wind wehte durch die Bäume.
Könntest du bitte das Fenster öffnen? Mach das Licht aus, bevor du das Zimmer verlässt. Die Küche ist neben dem Bad und das Schlafzimmer ist oben. Ich muss den Boden putzen, das Geschirr spülen und den Müll wegbringen. Wo sind die Schlüssel für die Haustür?
Er steht jeden Tag früh auf und fährt mit dem Bus zur Arbeit. Sie fängt um neun Uhr an und kommt abends um sechs zurück. Sie suchen eine neue Stelle, weil die Firma geschlossen hat. Ihr Chef ist nie mit etwas zufrieden. Wie viel Geld verdienst du jeden Monat?
Ich hätte gern eine Tasse Kaffee mit Milch und Zucker. Hast du Hunger oder Durst? Das Essen ist fertig, kommt und setzt euch an den Tisch. Wir haben auf dem Markt Brot, Butter, Käse, Eier, Fleisch, Fisch, Äpfel und Kartoffeln gekauft. Diese Suppe schmeckt wunderbar. Die Rechnung, bitte.
Die Kinder spielen draußen mit dem Hund. Unsere Tochter geht zur Schule und unser Sohn ist noch ein Baby. Seine Großmutter ist neunzig Jahre alt. Ihr Vater starb letztes Jahr nach langer Krankheit. Sie haben im Frühling geheiratet. Mein Bruder und meine Schwester leben im Ausland.
Ich fühle mich nicht wohl, mein Kopf tut weh und ich habe Fieber. Du solltest so bald wie möglich zum Arzt gehen. Nehmen Sie dieses Medikament dreimal am Tag nach dem Essen. Sie hat sich das Bein gebrochen und musste zwei Wochen im Krankenhaus bleiben. Trink viel Wasser und schlaf ein wenig.
Wie weit ist es bis zum Bahnhof? Gehen Sie geradeaus, dann an der Ecke links und hinter der Brücke rechts. Der Zug fährt um zehn vor acht ab. Wir haben das Flugzeug verpasst, deshalb mussten wir bis zum nächsten Morgen warten. Er fährt sein Auto viel zu schnell. Die Straße war leer und dunkel.
Hast du die Nachrichten gehört? Die Regierung will nächstes Jahr die Steuern erhöhen. Die Polizei hat den Dieb gefasst, der das Fahrrad gestohlen hatte. Tausende Menschen gingen gegen den Krieg auf die Straße. Der Präsident hielt eine lange Rede über Frieden und Freiheit. Niemand weiß, was geschehen wird.
Ich lese gern Bücher und höre gern Musik. Welchen Film hast du im Fernsehen gesehen? Sie singt gut und spielt noch besser Klavier. Unsere Mannschaft hat das Spiel mit drei Toren gewonnen. Sie tanzten bis Mitternacht. Lass uns am Sonntag im Meer schwimmen gehen.
Können Sie mir bei diesem Problem helfen? Natürlich, ich werde mein Bestes tun. Ich verstehe nicht, was du meinst, kannst du es bitte noch einmal langsam sagen? Du hast recht, das war mein Fehler. Macht nichts, das ist egal. Es tut mir leid, dass ich zu spät komme. Bis bald und alles Gute.
Diese Schuhe sind mir zu groß, haben Sie ein kleineres Paar? Das blaue Kleid ist billiger als das rote. Wie viel kostet das? Ich habe zwanzig Euro für ein weißes Hemd bezahlt. Das Geschäft schließt am Samstag um zwölf. Mein Telefon ist kaputt und ich brauche ein anderes.
Es war einmal ein König, der hatte drei schöne Töchter. Niemand durfte nachts den Wald betreten. Plötzlich hörte er hinter sich ein schreckliches Geräusch. Sie sah ihn an, ohne ein Wort zu sagen. Am Ende lebten sie glücklich und zufrieden. Der alte Mann setzte sich unter einen Baum und dachte über sein Leben nach.
Pferde, Kühe, Schweine, Schafe und Vögel leben auf einem Bauernhof. Die Katze schläft auf dem Dach. Im Garten wachsen Blumen und im Herbst fallen die Blätter. Die Erde dreht sich um die Sonne. Der größte Teil der Welt ist mit Wasser bedeckt. Sterne kann man nur sehen, wenn der Himmel klar ist.
Bitte schreiben Sie hier Ihren Namen und Ihre Adresse auf. Hast du ihren Brief schon beantwortet? Der Lehrer stellte eine schwierige Frage, die keiner beantworten konnte. Ich lernte schreiben, als ich fünf war. Er spricht mehrere Sprachen. Es ist wichtig, nachzudenken, bevor man handelt. Alles hat seinen Preis. Jemand muss ihnen davon erzählt haben.
Montag, Dienstag, Mittwoch, Donnerstag, Freitag, Samstag, Sonntag. Januar, Februar, März, April, Mai, Juni, Juli, August, September, Oktober, November, Dezember. Eins, zwei, drei, vier, fünf, sechs, sieben, acht, neun, zehn, elf, zwölf, zwanzig, dreißig, vierzig, fünfzig, hundert, tausend.
Mein Nachbar hat am Wochenende den Zaun repariert. Würden Sie kurz diese Tasche halten? In der Suppe fehlt noch etwas Salz. Wir planen im Mai eine Reise nach Schottland. Niemand ging ans Telefon. Sie hat ihren Regenschirm im Bus vergessen. Das Museum ist an Feiertagen geschlossen. Ich kann meine Brille nirgends finden. Er arbeitet hier, seit er achtzehn ist. Bitte schnallen Sie sich an. Das Baby ist endlich eingeschlafen. Unser Flug hatte zwei Stunden Verspätung. Sie haben ihren alten Wagen günstig verkauft. In der Badewanne sitzt eine Spinne. Hast du schon einmal rohen Fisch gegessen? Der Fluss überschwemmte das ganze Dorf. Ich bleibe heute Abend lieber zu Hause. Seine Handschrift kann man kaum lesen. Der Teppich war voller Staub. Wer hat das Tor offen gelassen? Du solltest dich bei deiner Cousine entschuldigen. Mit dem Zug dauert es etwa eine Stunde. Das Konzert beginnt pünktlich um acht. Mein Akku ist fast leer. Sie trug einen grünen Schal und lange Handschuhe. Vielen Dank für die schönen Blumen. Ich wurde in einer kleinen Stadt an der Küste geboren. Der Zahnarzt sagte, ich soll am Donnerstag wiederkommen. Sag mir Bescheid, wenn du angekommen bist. Sie stritten den ganzen Abend über Politik. In der Bäckerei duftet es nach frischen Brötchen. Er hat vor drei Jahren mit dem Rauchen aufgehört. Ist dieser Platz noch frei? Mitten im Nirgendwo ging uns das Benzin aus. Der Richter glaubte dem Zeugen nicht. Stell die Butter zurück in den Kühlschrank. Sie ist gegen Nüsse allergisch. Es war eiskalt, also machten wir Feuer. Die Brücke wurde vor zweihundert Jahren gebaut. Das war mir noch nie so peinlich. Kann ich mit Karte zahlen? Unser Vermieter erhöht schon wieder die Miete. Der Welpe hat meine Hausschuhe zerkaut. Er tat so, als hörte er uns nicht. Wir betrachteten vom Dach aus die Sterne. Der Schlüssel muss in deiner Jackentasche sein. Ihre Stimme zitterte leicht. Das Frühstück ist im Preis enthalten. Nicht anfassen, frisch gestrichen. Hinter der Scheune pflanzten sie drei Apfelbäume. Ich verpasste den letzten Bus und musste laufen. Der Motor macht ein seltsames Geräusch. Alle lachten, nur er nicht. Sie unterrichtet Geschichte an einer Dorfschule. Die Milch ist sauer geworden. Wir sollten los, bevor es dunkel wird. Das Messer ist nicht scharf genug. Er flüsterte ihr etwas ins Ohr. Meine Schuhe sind noch schmutzig. Das war eine kluge Idee.""",
    "fra": """Bonjour, comment allez-vous aujourd'hui ? Je vais bien, merci, et comment va ta famille ? Je m'appelle Pierre et voici ma femme. Nous habitons dans une petite maison près de l'église. Quelle heure est-il maintenant ? Il est presque sept heures et demie.
Il faisait très mauvais hier, mais le temps s'améliore. Il pleuvra encore demain et il fera froid la nuit. En été, le soleil brille toute la journée. Il y a de la neige sur les montagnes et de la glace sur le lac. Un vent fort soufflait à travers les arbres.
Pourrais-tu ouvrir la fenêtre, s'il te plaît ? Éteins la lumière avant de quitter la chambre. La cuisine est à côté de la salle de bains et la chambre est en haut. Je dois nettoyer le sol, faire la vaisselle et sortir les poubelles. Où sont les clés de la porte d'entrée ?
Il se lève tôt tous les jours et va au travail en bus. Elle commence à neuf heures et rentre à six heures du soir. Ils cherchent un nouvel emploi parce que l'entreprise a fermé. Son patron n'est jamais content de rien. Combien d'argent gagnes-tu chaque mois ?
Je voudrais une tasse de café avec du lait et du sucre. As-tu faim ou soif ? Le dîner est prêt, venez vous asseoir à table. Nous avons acheté du pain, du beurre, du fromage, des œufs, de la viande, du poisson, des pommes et des pommes de terre au marché. Cette soupe est délicieuse. L'addition, s'il vous plaît.
Les enfants jouent dehors avec le chien. Notre fille va à l'école et notre fils est encore un bébé. Sa grand-mère a quatre-vingt-dix ans. Son père est mort l'année dernière après une longue maladie. Ils se sont mariés au printemps. Mon frère et ma sœur vivent à l'étranger.
Je ne me sens pas bien, j'ai mal à la tête et j'ai de la fièvre. Tu devrais voir un médecin le plus tôt possible. Prenez ce médicament trois fois par jour après les repas. Elle s'est cassé la jambe et a dû rester deux semaines à l'hôpital. Bois beaucoup d'eau et dors un peu.
À quelle distance est la gare ? Allez tout droit, puis tournez à gauche au coin et à droite derrière le pont. Le train part à huit heures moins dix. Nous avons raté l'avion, nous avons donc dû attendre jusqu'au lendemain matin. Il conduit sa voiture beaucoup trop vite. La rue était vide et sombre.
As-tu entendu les nouvelles ? Le gouvernement veut augmenter les impôts l'année prochaine. La police a arrêté le voleur qui avait volé le vélo. Des milliers de gens sont descendus dans la rue contre la guerre. Le président a fait un long discours sur la paix et la liberté. Personne ne sait ce qui va se passer.
J'aime lire des livres et écouter de la musique. Quel film as-tu regardé à la télévision ? Elle chante bien et joue encore mieux du piano. Notre équipe a gagné le match par trois buts. Ils ont dansé jusqu'à minuit. Allons nager dans la mer dimanche.
Pouvez-vous m'aider avec ce problème ? Bien sûr, je ferai de mon mieux. Je ne comprends pas ce que tu veux dire, peux-tu le répéter lentement ? Tu as raison, c'était mon erreur. Ça ne fait rien, ce n'est pas grave. Je suis désolé d'être en retard. À bientôt et bonne chance.
Ces chaussures sont trop grandes pour moi, avez-vous une paire plus petite ? La robe bleue est moins chère que la rouge. Combien ça coûte ? J'ai payé vingt euros pour une chemise blanche. Le magasin ferme à midi le samedi. Mon téléphone est cassé et il m'en faut un autre.
Il était une fois un roi qui avait trois belles filles. Personne n'avait le droit d'entrer dans la forêt la nuit. Soudain il entendit un bruit terrible derrière lui. Elle le regarda sans dire un mot. À la fin ils vécurent heureux. Le vieil homme s'assit sous un arbre et réfléchit à sa vie.
Des chevaux, des vaches, des cochons, des moutons et des oiseaux vivent dans une ferme. Le chat dort sur le toit. Les fleurs poussent dans le jardin et les feuilles tombent en automne. La terre tourne autour du soleil. La plus grande partie du monde est couverte d'eau. On ne voit les étoiles que si le ciel est clair.
Veuillez écrire ici votre nom et votre adresse. As-tu déjà répondu à sa lettre ? Le professeur a posé une question difficile à laquelle personne n'a pu répondre. J'ai appris à écrire quand j'avais cinq ans. Il parle plusieurs langues. Il est important de réfléchir avant d'agir. Tout a son prix. Quelqu'un a dû leur en parler.
Lundi, mardi, mercredi, jeudi, vendredi, samedi, dimanche. Janvier, février, mars, avril, mai, juin, juillet, août, septembre, octobre, novembre, décembre. Un, deux, trois, quatre, cinq, six, sept, huit, neuf, dix, onze, douze, vingt, trente, quarante, cinquante, cent, mille.
Mon voisin a réparé la clôture le week-end dernier. Pourriez-vous tenir ce sac un instant ? La soupe manque un peu de sel. Nous préparons un voyage en Écosse au mois de mai. Personne n'a répondu au téléphone. Elle a oublié son parapluie dans le bus. Le musée est fermé les jours fériés. Je ne trouve mes lunettes nulle part. Il travaille ici depuis qu'il a dix-huit ans. Veuillez attacher vos ceintures. Le bébé s'est enfin endormi. Notre vol a eu deux heures de retard. Ils ont vendu leur vieille voiture à bon prix. Il y a une araignée dans la baignoire. As-tu déjà mangé du poisson cru ? La rivière a inondé tout le village. Je préfère rester à la maison ce soir. Son écriture est presque illisible. Le tapis était couvert de poussière. Qui a laissé le portail ouvert ? Tu devrais t'excuser auprès de ta cousine. En train, cela prend environ une heure. Le concert commence à huit heures précises. Ma batterie est presque vide. Elle portait une écharpe verte et de longs gants. Merci pour ces jolies fleurs. Je suis né dans une petite ville au bord de la côte. Le dentiste m'a dit de revenir jeudi. Préviens-moi quand tu seras arrivé. Ils se sont disputés toute la soirée à propos de politique. La boulangerie sent bon le pain frais. Il a arrêté de fumer il y a trois ans. Cette place est-elle libre ? Nous sommes tombés en panne d'essence au milieu de nulle part. Le juge n'a pas cru le témoin. Remets le beurre au réfrigérateur. Elle est allergique aux noix. Il gelait, alors nous avons allumé un feu. Le pont a été construit il y a deux cents ans. Je n'ai jamais eu aussi honte. Puis-je payer par carte ? Notre propriétaire augmente encore le loyer. Le chiot a mordillé mes pantoufles. Il a fait semblant de ne pas nous entendre. Nous regardions les étoiles depuis le toit. Les clés doivent être dans la poche de ta veste. Sa voix tremblait légèrement. Le petit déjeuner est compris dans le prix. Ne touchez pas la peinture fraîche. Ils ont planté trois pommiers derrière la grange. J'ai manqué le dernier bus et j'ai dû marcher. Le moteur fait un bruit étrange. Tout le monde a ri sauf lui. Elle enseigne l'histoire dans une école de village. Le lait a tourné. Nous devrions partir avant la nuit. Le couteau n'est pas assez aiguisé. Il lui murmura quelque chose à l'oreille. Mes chaussures sont encore boueuses. C'était une idée astucieuse.""",
    "spa": """Buenos días, ¿cómo está usted hoy? Estoy bien, gracias, ¿y cómo está tu familia? Me llamo Pedro y esta es mi mujer. Vivimos en una casa pequeña cerca de la iglesia. ¿Qué hora es ahora? Son casi las siete y media.
Ayer hizo muy mal tiempo, pero está mejorando. Mañana lloverá otra vez y hará frío por la noche. En verano el sol brilla todo el día. Hay nieve en las montañas y hielo en el lago. Un viento fuerte soplaba entre los árboles.
¿Podrías abrir la ventana, por favor? Apaga la luz antes de salir de la habitación. La cocina está al lado del baño y el dormitorio está arriba. Tengo que limpiar el suelo, lavar los platos y sacar la basura. ¿Dónde están las llaves de la puerta de casa?
Él se levanta temprano todos los días y va al trabajo en autobús. Ella empieza a las nueve y vuelve a las seis de la tarde. Buscan un nuevo empleo porque la empresa ha cerrado. Su jefe nunca está contento con nada. ¿Cuánto dinero ganas cada mes?
Quisiera una taza de café con leche y azúcar. ¿Tienes hambre o sed? La cena está lista, venid a sentaros a la mesa. Compramos pan, mantequilla, queso, huevos, carne, pescado, manzanas y patatas en el mercado. Esta sopa está riquísima. La cuenta, por favor.
Los niños juegan fuera con el perro. Nuestra hija va a la escuela y nuestro hijo todavía es un bebé. Su abuela tiene noventa años. Su padre murió el año pasado después de una larga enfermedad. Se casaron en primavera. Mi hermano y mi hermana viven en el extranjero.
No me siento bien, me duele la cabeza y tengo fiebre. Deberías ver a un médico lo antes posible. Tome esta medicina tres veces al día después de las comidas. Ella se rompió la pierna y tuvo que quedarse dos semanas en el hospital. Bebe mucha agua y duerme un poco.
¿A qué distancia está la estación? Siga todo recto, luego gire a la izquierda en la esquina y a la derecha detrás del puente. El tren sale a las ocho menos diez. Perdimos el avión, así que tuvimos que esperar hasta la mañana siguiente. Él conduce su coche demasiado rápido. La calle estaba vacía y oscura.
¿Has oído las noticias? El gobierno quiere subir los impuestos el próximo año. La policía detuvo al ladrón que había robado la bicicleta. Miles de personas salieron a la calle contra la guerra. El presidente dio un largo discurso sobre la paz y la libertad. Nadie sabe qué va a pasar.
Me gusta leer libros y escuchar música. ¿Qué película viste en la televisión? Ella canta bien y toca aún mejor el piano. Nuestro equipo ganó el partido por tres goles. Bailaron hasta la medianoche. Vamos a nadar en el mar el domingo.
¿Puede ayudarme con este problema? Claro, haré todo lo posible. No entiendo lo que quieres decir, ¿puedes repetirlo despacio? Tienes razón, fue mi error. No pasa nada, no importa. Siento llegar tarde. Hasta pronto y mucha suerte.
Estos zapatos me quedan demasiado grandes, ¿tiene un par más pequeño? El vestido azul es más barato que el rojo. ¿Cuánto cuesta? Pagué veinte euros por una camisa blanca. La tienda cierra a mediodía los sábados. Mi teléfono está roto y necesito otro.
Había una vez un rey que tenía tres hijas hermosas. Nadie podía entrar en el bosque de noche. De repente oyó un ruido terrible detrás de él. Ella lo miró sin decir una palabra. Al final vivieron felices. El viejo se sentó bajo un árbol y pensó en su vida.
En una granja viven caballos, vacas, cerdos, ovejas y pájaros. El gato duerme en el tejado. En el jardín crecen flores y en otoño caen las hojas. La tierra gira alrededor del sol. La mayor parte del mundo está cubierta de agua. Las estrellas solo se ven cuando el cielo está despejado.
Escriba aquí su nombre y su dirección. ¿Ya has contestado a su carta? El profesor hizo una pregunta difícil que nadie pudo responder. Aprendí a escribir cuando tenía cinco años. Él habla varios idiomas. Es importante pensar antes de actuar. Todo tiene su precio. Alguien debe habérselo contado.
Lunes, martes, miércoles, jueves, viernes, sábado, domingo. Enero, febrero, marzo, abril, mayo, junio, julio, agosto, septiembre, octubre, noviembre, diciembre. Uno, dos, tres, cuatro, cinco, seis, siete, ocho, nueve, diez, once, doce, veinte, treinta, cuarenta, cincuenta, cien, mil.
Mi vecino arregló la valla el fin de semana pasado. ¿Le importaría sujetar esta bolsa un momento? A la sopa le falta un poco de sal. Estamos planeando un viaje a Escocia en mayo. Nadie contestó al teléfono. Se dejó el paraguas en el autobús. El museo cierra los días festivos. No encuentro mis gafas por ninguna parte. Trabaja aquí desde que tenía dieciocho años. Abróchense los cinturones, por favor. El bebé por fin se durmió. Nuestro vuelo se retrasó dos horas. Vendieron su viejo coche a buen precio. Hay una araña en la bañera. ¿Alguna vez has comido pescado crudo? El río inundó todo el pueblo. Esta noche prefiero quedarme en casa. Su letra es casi imposible de leer. La alfombra estaba cubierta de polvo. ¿Quién dejó la puerta del jardín abierta? Deberías pedirle perdón a tu prima. En tren se tarda más o menos una hora. El concierto empieza a las ocho en punto. Mi batería está casi agotada. Llevaba una bufanda verde y guantes largos. Gracias por estas flores tan bonitas. Nací en una ciudad pequeña junto a la costa. El dentista me dijo que volviera el jueves. Avísame cuando llegues. Discutieron sobre política toda la tarde. La panadería huele a pan recién hecho. Dejó de fumar hace tres años. ¿Está libre este asiento? Nos quedamos sin gasolina en medio de la nada. El juez no creyó al testigo. Vuelve a poner la mantequilla en la nevera. Es alérgica a los frutos secos. Hacía un frío terrible, así que encendimos un fuego. El puente se construyó hace doscientos años. Nunca había pasado tanta vergüenza. ¿Puedo pagar con tarjeta? Nuestro casero vuelve a subir el alquiler. El cachorro mordió mis zapatillas. Hizo como que no nos oía. Mirábamos las estrellas desde la azotea. Las llaves deben de estar en el bolsillo de tu chaqueta. Le temblaba un poco la voz. El desayuno está incluido en el precio. No toquen la pintura fresca. Plantaron tres manzanos detrás del granero. Perdí el último autobús y tuve que caminar. El motor hace un ruido extraño. Todos se rieron menos él. Enseña historia en una escuela de pueblo. La leche se ha puesto agria. Deberíamos irnos antes de que anochezca. El cuchillo no está bastante afilado. Le susurró algo al oído. Mis zapatos todavía tienen barro. Fue una idea muy ingeniosa.""",
    "hin": """नमस्ते, आज आप कैसे हैं? मैं ठीक हूँ, धन्यवाद, और आपका परिवार कैसा है? मेरा नाम रवि है और यह मेरी पत्नी है। हम मंदिर के पास एक छोटे घर में रहते हैं। अभी कितने बजे हैं? लगभग साढ़े सात बज गए हैं।
कल मौसम बहुत खराब था, लेकिन अब अच्छा हो रहा है। कल फिर बारिश होगी और रात को ठंड पड़ेगी। गर्मी में दिन भर धूप रहती है। पहाड़ों पर बर्फ़ है और झील जम गई है। पेड़ों के बीच तेज़ हवा चल रही थी।
क्या आप खिड़की खोल सकते हैं? कमरे से निकलने से पहले बत्ती बंद कर दो। रसोई स्नानघर के बगल में है और सोने का कमरा ऊपर है। मुझे फ़र्श साफ़ करना है, बर्तन धोने हैं और कूड़ा बाहर फेंकना है। दरवाज़े की चाबियाँ कहाँ हैं?
वह हर दिन जल्दी उठता है और बस से काम पर जाता है। वह नौ बजे शुरू करती है और शाम को छह बजे वापस आती है। वे नई नौकरी ढूँढ रहे हैं क्योंकि कंपनी बंद हो गई। उसका मालिक कभी किसी बात से खुश नहीं होता। तुम हर महीने कितना पैसा कमाते हो?
मुझे दूध और चीनी वाली एक प्याली चाय चाहिए। तुम्हें भूख लगी है या प्यास? खाना तैयार है, आओ और मेज़ पर बैठो। हमने बाज़ार से रोटी, मक्खन, पनीर, अंडे, मांस, मछली, सेब और आलू खरीदे। यह दाल बहुत स्वादिष्ट है।
बच्चे बाहर कुत्ते के साथ खेल रहे हैं। हमारी बेटी स्कूल जाती है और हमारा बेटा अभी छोटा है। उसकी दादी नब्बे साल की हैं। उसके पिता पिछले साल लंबी बीमारी के बाद चल बसे। उन्होंने वसंत में शादी की। मेरा भाई और मेरी बहन विदेश में रहते हैं।
मेरी तबीयत ठीक नहीं है, सिर में दर्द है और बुखार है। तुम्हें जल्दी से जल्दी डॉक्टर को दिखाना चाहिए। यह दवा दिन में तीन बार खाने के बाद लीजिए। उसकी टाँग टूट गई और उसे दो हफ़्ते अस्पताल में रहना पड़ा। खूब पानी पियो और थोड़ा सो जाओ।
स्टेशन यहाँ से कितनी दूर है? सीधे जाइए, फिर कोने पर बाएँ और पुल के पीछे दाएँ मुड़िए। रेलगाड़ी आठ बजने से दस मिनट पहले छूटती है। हमारा जहाज़ छूट गया, इसलिए हमें अगली सुबह तक रुकना पड़ा। वह अपनी गाड़ी बहुत तेज़ चलाता है। सड़क खाली और अँधेरी थी।
क्या तुमने समाचार सुना? सरकार अगले साल कर बढ़ाना चाहती है। पुलिस ने उस चोर को पकड़ लिया जिसने साइकिल चुराई थी। हज़ारों लोग युद्ध के खिलाफ़ सड़क पर उतर आए। राष्ट्रपति ने शांति और आज़ादी पर लंबा भाषण दिया। कोई नहीं जानता कि आगे क्या होगा।
मुझे किताबें पढ़ना और संगीत सुनना पसंद है। तुमने टीवी पर कौन सी फ़िल्म देखी? वह अच्छा गाती है और उससे भी अच्छा बजाती है। हमारी टीम ने मैच तीन गोल से जीत लिया। वे आधी रात तक नाचते रहे। रविवार को चलो समुद्र में तैरने चलें।
क्या आप इस समस्या में मेरी मदद कर सकते हैं? ज़रूर, मैं पूरी कोशिश करूँगा। मैं नहीं समझा कि आप क्या कहना चाहते हैं, कृपया धीरे से दोबारा बोलिए। आप सही कह रहे हैं, वह मेरी गलती थी। कोई बात नहीं। माफ़ कीजिए, मुझे देर हो गई। फिर मिलेंगे, अपना ध्यान रखना।
ये जूते मेरे लिए बहुत बड़े हैं, क्या आपके पास छोटे हैं? नीली साड़ी लाल वाली से सस्ती है। इसका दाम कितना है? मैंने सफ़ेद कमीज़ के लिए बीस रुपये दिए। दुकान शनिवार को दोपहर में बंद हो जाती है। मेरा फ़ोन खराब है और मुझे दूसरा चाहिए।
बहुत समय पहले एक राजा था जिसकी तीन सुंदर बेटियाँ थीं। रात को जंगल में जाने की किसी को अनुमति नहीं थी। अचानक उसने अपने पीछे एक भयानक आवाज़ सुनी। उसने बिना कुछ कहे उसकी ओर देखा। अंत में सब सुख से रहने लगे। बूढ़ा आदमी पेड़ के नीचे बैठकर अपने जीवन के बारे में सोचने लगा।
खेत में घोड़े, गाय, भैंस, भेड़ और चिड़ियाँ रहती हैं। बिल्ली छत पर सोती है। बगीचे में फूल खिलते हैं और पतझड़ में पत्ते गिरते हैं। पृथ्वी सूरज के चारों ओर घूमती है। दुनिया का अधिकतर हिस्सा पानी से ढका है। तारे तभी दिखते हैं जब आसमान साफ़ हो।
कृपया यहाँ अपना नाम और पता लिखिए। क्या तुमने उसके पत्र का जवाब दे दिया? अध्यापक ने एक कठिन सवाल पूछा जिसका उत्तर कोई नहीं दे सका। जब मैं पाँच साल का था तब मैंने लिखना सीखा। वह कई भाषाएँ बोलता है। कुछ करने से पहले सोचना ज़रूरी है। हर चीज़ की कीमत होती है। किसी ने उन्हें इसके बारे में बताया होगा।
सोमवार, मंगलवार, बुधवार, गुरुवार, शुक्रवार, शनिवार, रविवार। जनवरी, फ़रवरी, मार्च, अप्रैल, मई, जून, जुलाई, अगस्त, सितंबर, अक्टूबर, नवंबर, दिसंबर। एक, दो, तीन, चार, पाँच, छह, सात, आठ, नौ, दस, ग्यारह, बारह, बीस, तीस, चालीस, पचास, सौ, हज़ार।
मेरे पड़ोसी ने पिछले हफ़्ते बाड़ की मरम्मत की। क्या आप ज़रा यह थैला पकड़ेंगे? दाल में थोड़ा नमक कम है। हम मई में शिमला जाने की योजना बना रहे हैं। किसी ने फ़ोन नहीं उठाया। वह अपनी छतरी बस में भूल आई। छुट्टियों में संग्रहालय बंद रहता है। मुझे अपना चश्मा कहीं नहीं मिल रहा। वह अठारह साल की उम्र से यहाँ काम कर रहा है। कृपया अपनी पेटी बाँध लीजिए। बच्चा आखिरकार सो गया। हमारी उड़ान दो घंटे देर से चली। उन्होंने अपनी पुरानी कार अच्छे दाम में बेच दी। नहाने के टब में मकड़ी है। क्या तुमने कभी कच्ची मछली खाई है? नदी ने पूरे गाँव को डुबो दिया। आज शाम मैं घर पर ही रहना चाहूँगा। उसकी लिखावट पढ़ना लगभग असंभव है। कालीन धूल से भरा था। फाटक खुला किसने छोड़ा? तुम्हें अपनी बहन से माफ़ी माँगनी चाहिए। रेल से लगभग एक घंटा लगता है। कार्यक्रम ठीक आठ बजे शुरू होगा। मेरी बैटरी खत्म होने वाली है। उसने हरा दुपट्टा और लंबे दस्ताने पहने थे। इतने सुंदर फूलों के लिए शुक्रिया। मेरा जन्म समुद्र किनारे एक छोटे शहर में हुआ था। दाँत के डॉक्टर ने मुझे गुरुवार को फिर बुलाया है। पहुँचकर मुझे बता देना। वे पूरी शाम राजनीति पर बहस करते रहे। बेकरी से ताज़ी रोटी की खुशबू आ रही है। उसने तीन साल पहले धूम्रपान छोड़ दिया। क्या यह सीट खाली है? बीच रास्ते में हमारा पेट्रोल खत्म हो गया। न्यायाधीश ने गवाह पर विश्वास नहीं किया। मक्खन वापस फ़्रिज में रख दो। उसे मेवों से एलर्जी है। कड़ाके की ठंड थी, इसलिए हमने आग जलाई। यह पुल दो सौ साल पहले बना था। मुझे इतनी शर्म पहले कभी नहीं आई। क्या मैं कार्ड से भुगतान कर सकता हूँ? हमारा मकान मालिक फिर किराया बढ़ा रहा है। पिल्ले ने मेरी चप्पलें चबा डालीं। उसने ऐसा दिखाया जैसे सुना ही न हो। हम छत से तारे देखते रहे। चाबी तुम्हारी जेब में ही होगी। उसकी आवाज़ हल्की सी काँप रही थी। नाश्ता दाम में शामिल है। गीले रंग को मत छुओ। उन्होंने खलिहान के पीछे तीन आम के पेड़ लगाए। आखिरी बस छूट गई और मुझे पैदल चलना पड़ा। इंजन से अजीब आवाज़ आ रही है। उसके सिवा सब हँस पड़े। वह गाँव के स्कूल में इतिहास पढ़ाती है। दूध फट गया है। हमें अँधेरा होने से पहले निकल जाना चाहिए। चाकू तेज़ नहीं है। उसने उसके कान में कुछ फुसफुसाया। मेरे जूतों में अभी भी कीचड़ लगा है। वह बड़ी चतुर तरकीब थी।""",
    "mar": """नमस्कार, आज तुम्ही कसे आहात? मी बरा आहे, धन्यवाद, आणि तुमचे कुटुंब कसे आहे? माझे नाव रवी आहे आणि ही माझी बायको आहे. आम्ही देवळाजवळ एका लहान घरात राहतो. आता किती वाजले आहेत? जवळजवळ साडेसात वाजले आहेत.
काल हवामान खूप वाईट होते, पण आता ते सुधारत आहे. उद्या पुन्हा पाऊस पडेल आणि रात्री थंडी वाजेल. उन्हाळ्यात दिवसभर ऊन असते. डोंगरावर बर्फ आहे आणि तलाव गोठला आहे. झाडांमधून जोराचा वारा वाहत होता.
तुम्ही खिडकी उघडाल का? खोलीतून बाहेर जाण्यापूर्वी दिवा बंद कर. स्वयंपाकघर न्हाणीघराच्या शेजारी आहे आणि झोपण्याची खोली वर आहे. मला फरशी पुसायची आहे, भांडी धुवायची आहेत आणि कचरा बाहेर टाकायचा आहे. दाराच्या किल्ल्या कुठे आहेत?
तो रोज लवकर उठतो आणि बसने कामाला जातो. ती नऊ वाजता सुरू करते आणि संध्याकाळी सहा वाजता परत येते. ते नवीन नोकरी शोधत आहेत कारण कंपनी बंद झाली. तिचा साहेब कधीच कशावरही खूश नसतो. तू दर महिन्याला किती पैसे कमावतोस?
मला दूध आणि साखर घातलेला एक कप चहा हवा आहे. तुला भूक लागली आहे की तहान? जेवण तयार आहे, या आणि बसा. आम्ही बाजारातून भाकरी, लोणी, पनीर, अंडी, मटण, मासे, सफरचंद आणि बटाटे विकत घेतले. ही आमटी खूप चविष्ट आहे.
मुले बाहेर कुत्र्याबरोबर खेळत आहेत. आमची मुलगी शाळेत जाते आणि आमचा मुलगा अजून लहान आहे. त्याची आजी नव्वद वर्षांची आहे. तिचे वडील मागच्या वर्षी मोठ्या आजारानंतर वारले. त्यांनी वसंत ऋतूत लग्न केले. माझा भाऊ आणि माझी बहीण परदेशात राहतात.
मला बरे वाटत नाही, डोके दुखते आहे आणि ताप आला आहे. तू लवकरात लवकर डॉक्टरांना भेटायला हवेस. हे औषध दिवसातून तीन वेळा जेवणानंतर घ्या. तिचा पाय मोडला आणि तिला दोन आठवडे रुग्णालयात राहावे लागले. भरपूर पाणी पी आणि थोडा वेळ झोप.
स्टेशन इथून किती लांब आहे? सरळ जा, मग कोपऱ्यावर डावीकडे आणि पुलाच्या मागे उजवीकडे वळा. गाडी आठला दहा मिनिटे कमी असताना सुटते. आमचे विमान चुकले, म्हणून आम्हाला दुसऱ्या दिवशी सकाळपर्यंत थांबावे लागले. तो त्याची गाडी फारच वेगाने चालवतो. रस्ता रिकामा आणि अंधारा होता.
तू बातमी ऐकलीस का? सरकारला पुढच्या वर्षी कर वाढवायचा आहे. ज्याने सायकल चोरली होती त्या चोराला पोलिसांनी पकडले. हजारो लोक युद्धाविरुद्ध रस्त्यावर उतरले. राष्ट्रपतींनी शांतता आणि स्वातंत्र्यावर लांब भाषण दिले. पुढे काय होईल हे कोणालाच माहीत नाही.
मला पुस्तके वाचायला आणि संगीत ऐकायला आवडते. तू टीव्हीवर कोणता चित्रपट पाहिलास? ती छान गाते आणि त्याहूनही छान वाजवते. आमच्या संघाने सामना तीन गोलांनी जिंकला. ते मध्यरात्रीपर्यंत नाचत राहिले. रविवारी समुद्रात पोहायला जाऊया.
या अडचणीत तुम्ही मला मदत करू शकता का? नक्कीच, मी पूर्ण प्रयत्न करीन. तुम्हाला काय म्हणायचे आहे ते मला समजले नाही, कृपया पुन्हा हळू सांगा. तुझे बरोबर आहे, ती माझी चूक होती. काही हरकत नाही. उशीर झाल्याबद्दल माफ करा. पुन्हा भेटू, काळजी घे.
हे बूट मला खूप मोठे होतात, तुमच्याकडे लहान आहेत का? निळी साडी लाल साडीपेक्षा स्वस्त आहे. याची किंमत किती आहे? मी पांढऱ्या सदऱ्यासाठी वीस रुपये दिले. दुकान शनिवारी दुपारी बंद होते. माझा फोन बिघडला आहे आणि मला दुसरा हवा आहे.
फार पूर्वी एक राजा होता, त्याला तीन सुंदर मुली होत्या. रात्री जंगलात जायला कोणालाही परवानगी नव्हती. अचानक त्याने आपल्यामागे एक भयानक आवाज ऐकला. तिने काही न बोलता त्याच्याकडे पाहिले. शेवटी सगळे सुखाने राहू लागले. म्हातारा माणूस झाडाखाली बसून आपल्या आयुष्याचा विचार करू लागला.
शेतावर घोडे, गाई, म्हशी, मेंढ्या आणि पक्षी राहतात. मांजर छपरावर झोपते. बागेत फुले उमलतात आणि शरद ऋतूत पाने गळतात. पृथ्वी सूर्याभोवती फिरते. जगाचा बराचसा भाग पाण्याने झाकलेला आहे. आकाश निरभ्र असेल तरच तारे दिसतात.
कृपया इथे तुमचे नाव आणि पत्ता लिहा. तू तिच्या पत्राला उत्तर दिलेस का? शिक्षकांनी एक अवघड प्रश्न विचारला ज्याचे उत्तर कोणालाही देता आले नाही. मी पाच वर्षांचा असताना लिहायला शिकलो. त्याला अनेक भाषा येतात. काही करण्यापूर्वी विचार करणे महत्त्वाचे आहे. प्रत्येक गोष्टीची किंमत असते. कोणीतरी त्यांना याबद्दल सांगितले असेल.
सोमवार, मंगळवार, बुधवार, गुरुवार, शुक्रवार, शनिवार, रविवार. जानेवारी, फेब्रुवारी, मार्च, एप्रिल, मे, जून, जुलै, ऑगस्ट, सप्टेंबर, ऑक्टोबर, नोव्हेंबर, डिसेंबर. एक, दोन, तीन, चार, पाच, सहा, सात, आठ, नऊ, दहा, अकरा, बारा, वीस, तीस, चाळीस, पन्नास, शंभर, हजार.
माझ्या शेजाऱ्याने गेल्या आठवड्यात कुंपण दुरुस्त केले. जरा ही पिशवी धराल का? आमटीत थोडे मीठ कमी आहे. आम्ही मे महिन्यात महाबळेश्वरला जायचा बेत करत आहोत. कोणीच फोन उचलला नाही. ती तिची छत्री बसमध्ये विसरली. सुट्टीच्या दिवशी संग्रहालय बंद असते. मला माझा चष्मा कुठेच सापडत नाही. तो अठरा वर्षांचा असल्यापासून इथे काम करतो. कृपया आपला पट्टा बांधा. बाळ एकदाचे झोपले. आमचे उड्डाण दोन तास उशिरा झाले. त्यांनी त्यांची जुनी गाडी चांगल्या किमतीला विकली. न्हाणीघरात कोळी आहे. तू कधी कच्चा मासा खाल्ला आहेस का? नदीच्या पुरात सगळे गाव बुडाले. आज संध्याकाळी मी घरीच राहीन. त्याचे अक्षर वाचणे जवळजवळ अशक्य आहे. गालिचा धुळीने भरला होता. फाटक उघडे कोणी ठेवले? तू तुझ्या बहिणीची माफी मागायला हवीस. आगगाडीने साधारण एक तास लागतो. कार्यक्रम बरोबर आठ वाजता सुरू होईल. माझी बॅटरी संपत आली आहे. तिने हिरवी ओढणी आणि लांब हातमोजे घातले होते. इतक्या सुंदर फुलांबद्दल आभार. माझा जन्म समुद्रकिनाऱ्यावरच्या एका लहान गावात झाला. दाताच्या डॉक्टरांनी मला गुरुवारी पुन्हा बोलावले आहे. पोहोचल्यावर मला कळव. ते संध्याकाळभर राजकारणावर वाद घालत होते. बेकरीतून ताज्या पावाचा वास येतो. त्याने तीन वर्षांपूर्वी धूम्रपान सोडले. ही जागा रिकामी आहे का? मध्येच आमचे पेट्रोल संपले. न्यायाधीशांनी साक्षीदारावर विश्वास ठेवला नाही. लोणी परत फ्रिजमध्ये ठेव. तिला सुक्या मेव्याची ॲलर्जी आहे. कडाक्याची थंडी होती, म्हणून आम्ही शेकोटी पेटवली. हा पूल दोनशे वर्षांपूर्वी बांधला होता. मला इतकी लाज कधीच वाटली नव्हती. मी कार्डने पैसे देऊ शकतो का? आमचा घरमालक पुन्हा भाडे वाढवत आहे. कुत्र्याच्या पिल्लाने माझ्या चपला चावल्या. त्याने आमचे ऐकलेच नाही असे दाखवले. आम्ही गच्चीवरून तारे पाहत होतो. किल्ली तुझ्या खिशातच असेल. तिचा आवाज थोडा थरथरत होता. किमतीत नाश्त्याचा समावेश आहे. ओल्या रंगाला हात लावू नका. त्यांनी गोठ्यामागे तीन आंब्याची झाडे लावली. शेवटची बस चुकली आणि मला चालत जावे लागले. इंजिनातून विचित्र आवाज येतो. त्याच्याखेरीज सगळे हसले. ती गावातल्या शाळेत इतिहास शिकवते. दूध नासले आहे. अंधार पडण्यापूर्वी आपण निघायला हवे. सुरीला धार नाही. त्याने तिच्या कानात काहीतरी कुजबुजले. माझ्या बुटांना अजून चिखल लागला आहे. ती फार हुशारीची कल्पना होती.""",
    "hin-latn": """Namaste, aaj aap kaise hain? Main theek hoon, dhanyavaad, aur aapka parivaar kaisa hai? Mera naam Ravi hai aur yeh meri patni hai. Hum mandir ke paas ek chhote ghar mein rehte hain. Kal mausam bahut kharab tha lekin ab achha ho raha hai. Kya aap khidki khol sakte hain? Mujhe chai chahiye. Tumhe bhookh lagi hai ya pyaas? Khana taiyar hai, aao aur baitho. Bachche bahar khel rahe hain. Meri tabiyat theek nahi hai. Woh apni gaadi bahut tez chalata hai. Koi nahi jaanta ki aage kya hoga. Mujhe kitaabein padhna aur gaane sunna pasand hai. Kya tum meri madad kar sakte ho? Koi baat nahi, phir milenge. Iska daam kitna hai? Kisi ne unhe iske baare mein bataya hoga. Woh har din jaldi uthta hai aur kaam par jaata hai. Unhone kaha ki woh kal wapas aayenge.""",
    "mar-latn": """Namaskar, aaj tumhi kase aahat? Mi bara aahe, dhanyavaad, ani tumche kutumb kase aahe? Majhe naav Ravi aahe ani hi majhi bayko aahe. Amhi devlajaval eka lahan gharat rahto. Kaal havaman khup vaait hote pan aata te sudharat aahe. Tumhi khidki ughdal ka? Mala chaha hava aahe. Tula bhuk lagli aahe ki tahan? Jevan tayar aahe, ya ani basa. Mule baher khelat aahet. Mala bare vatat nahi. To tyachi gaadi farach vegane chalavto. Pudhe kay hoil he konalach mahit nahi. Mala pustake vachayla ani gaani aikayla avadte. Tu mala madat karu shaktos ka? Kahi harkat nahi, punha bhetu. Yachi kimmat kiti aahe? Konitari tyanna yabaddal sangitle asel. To roj lavkar uthto ani kamala jato. Tyanni sangitle ki te udya parat yetil.""",
}
